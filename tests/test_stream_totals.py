from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxloom.functions import vectors as vx
from voxloom.operators import report, sampling, scoring
from voxloom.streaming import totals as st
from voxloom.streaming.state import MicroState


def scores(spark, numbers):
    """Scored and failed rows; some metrics are null."""
    rows = [(i, *((None,) * 5 if i % 9 == 4 else tuple(round((i * (7 + k) % 10_007) / 10_007, 4) if (i + k) % 13 else (None if k < 4 else 0.5) for k in range(5)))) for i in numbers]
    return spark.createDataFrame(rows, "sample_index int, " + ", ".join(f"{n} double" for n in vx.METRICS))


def cuts(n, parts):
    edges = [n * k // parts for k in range(parts + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:])]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_summary_of_any_cut(spark, tmp_path, parts):
    totals = st.summary_totals(str(tmp_path))
    for micro, numbers in enumerate(cuts(100, parts)):
        totals.add(scores(spark, numbers).repartition(3), micro)
        totals.add(scores(spark, numbers), micro)  # again: counted once
    got = st.streamed_summary(totals.read(spark))
    want = scoring.eval_summary(scores(spark, range(100)))
    assert got.dtypes == want.dtypes and got.collect() == want.collect()


def test_summary_of_nothing(spark, tmp_path):
    totals = st.summary_totals(str(tmp_path))
    totals.add(scores(spark, []), 0)
    assert st.streamed_summary(totals.read(spark)).collect() == scoring.eval_summary(scores(spark, [])).collect()
    with pytest.raises(ValueError, match="no micro-batch"):
        st.summary_totals(f"{tmp_path}/none").read(spark)


def prepared(spark, numbers):
    rows = [(f"s{i % 3}" if i % 7 else None, "bad" if i % 5 == 0 else None) for i in numbers]
    return spark.createDataFrame(rows, "source string, error string")


def test_counters_of_a_killed_stream(spark, tmp_path, monkeypatch):
    inbox, checkpoint = f"{tmp_path}/in", f"{tmp_path}/checkpoint"
    totals = st.counter_totals(f"{tmp_path}/state")

    def arrive(numbers):
        prepared(spark, numbers).write.mode("append").parquet(inbox)

    def run():
        totals.run(spark.readStream.schema("source string, error string").parquet(inbox), checkpoint).awaitTermination()

    arrive(range(30))
    run()
    arrive(range(30, 61))

    def dies(self, *mark, **values):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(MicroState, "finish", dies)
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    arrive(range(61, 80))
    run()
    got = st.streamed_counters(totals.read(spark)).collect()
    assert sorted(map(str, got)) == sorted(map(str, report.prep_counters(prepared(spark, range(80))).collect()))


@pytest.mark.parametrize("parts", [1, 3, 7])
@pytest.mark.parametrize("key", ["id", "k"])
def test_sample_of_any_cut(spark, tmp_path, parts, key):
    def rows(numbers):
        return spark.createDataFrame([(i, i % 4, f"t{i}") for i in numbers], "id long, k int, text string")

    for n in (17, 500):
        sample = st.StreamSample(f"{tmp_path}/{n}", n, [key])
        for micro, numbers in enumerate(cuts(90, parts)):
            sample.add(rows(numbers).repartition(2), micro)
        want = sampling.subsample(rows(range(90)), n, key=[key])
        assert sorted(map(tuple, sample.read(spark).collect())) == sorted(map(tuple, want.collect()))


def test_what_cannot_be_sampled_is_left_out_as_it_is_read(spark, tmp_path):
    sample = st.StreamSample(str(tmp_path), 5, ["id"])
    sample.add(spark.range(1000), 0)
    bound = sample.state.mark(spark, 0)["bound"]
    hashes = [r.h for r in sample.read(spark).select(sampling.order_hash(["id"], 42).alias("h")).collect()]
    assert bound == max(hashes) and len(hashes) == 5
    sample.add(spark.range(1000, 2000), 1)
    assert sample.read(spark).count() == 5 and sample.state.mark(spark, 1)["bound"] <= bound
    few = st.StreamSample(f"{tmp_path}/few", 5000, ["id"])
    few.add(spark.range(10), 0)
    assert few.state.mark(spark, 0)["bound"] is None
    assert few.read(spark).agg(F.count("*")).first()[0] == 10
