"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxloom.catalog import QUERIES
from voxloom.functions import vectors as vx
from voxloom.operators import batching
from voxloom.plans import training
from voxloom.sources import readers, writers
from voxloom.specs import CategoricalFilter, EncodedSource
from voxloom.vocab import LAYERS

from test_sources import encoded


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    writers.publish_encoded(encoded(spark, 200).withColumn("unused", F.lit("u")), root, "org/set")
    return root


def source(spark, stored, **more):
    return readers.load_encoded(spark, stored, EncodedSource("org/set", key_column="id", **more))


def test_filters_and_columns_reach_the_scan(spark, stored):
    df = source(spark, stored, categorical_filter=CategoricalFilter("speaker", "ann"))
    text = plan(training.training_set([(df, None)], max_seconds=30))
    assert "LessThanOrEqual(encoded_len,375)" in text
    assert "EqualTo(speaker,ann)" in text
    assert "unused" not in text


def test_training_set_moves_encoded_rows_once_and_needs_no_python(spark, stored):
    text = plan(training.training_set([(source(spark, stored), None)], max_seconds=30))
    assert text.count("Exchange ") == 1
    assert "shufflepartitionidpassthrough" in text
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    # the shuffled columns are the layers, not the four built arrays
    below = text.split("Exchange ", 1)[1]
    assert "input_ids" not in below and "nano_layer_1" in below


def test_batches_shuffle_the_payload_once(spark, stored):
    df = training.batches([(source(spark, stored), None)], batch_size=8, max_seconds=30)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    payload = [line for line in final.splitlines() if "shufflepartitionidpassthrough" in line]
    assert len([line for line in payload if "ReusedExchange" not in line]) == 1
    assert "ReusedExchange" in final
    assert "CartesianProduct" not in final and "NestedLoop" not in final


def test_batch_ranks_use_no_global_window_over_rows(spark, stored):
    df = batching.assign_batches(spark.range(1000), key=["id"], batch_size=8)
    text = plan(df)
    single = text.split("Exchange SinglePartition")
    # the only single partition lies above the per-bucket counts
    assert len(single) == 2 and "HashAggregate" in single[1]


def test_frames_are_zipped_once(spark, stored):
    optimized = (
        training.build_rows(training.sound_rows(source(spark, stored), max_seconds=30))
        ._jdf.queryExecution().optimizedPlan().toString()
    )
    assert optimized.count("filter(arrays_zip(") == 1


def test_cosine_stays_in_the_jvm(spark):
    df = spark.range(3).select(F.array(F.lit(1.0)).alias("a"))
    assert "Python" not in plan(df.select(vx.cosine_similarity("a", "a")))


def test_pushed_filter_does_not_make_frames_quadratic(spark):
    """A predicate on built columns is pushed below them; cost must stay linear in the frames."""
    import time

    def seconds(n):
        layers = [F.sequence(F.lit(k), F.lit(n + k)).alias(name) for k, name in enumerate(LAYERS)]
        rows = spark.range(0, 40, 1, 1).select(*layers, F.lit("t").alias("text"))
        from voxloom.operators import frames

        coded = frames.drop_empty_codes(frames.add_codes(frames.add_frames(rows)))
        coded.count()
        start = time.time()
        coded.agg(F.sum(F.size("codes_list"))).collect()
        return time.time() - start

    seconds(100)
    assert seconds(20_000) < 20


STORED = {
    "load_encoded", "requested_training_set", "requested_batches", "batch_stored_set", "build_report", "merged_json",
    "load_raw_audio", "publish_prepared", "evaluation_results", "streamed_training_rows",
    "streamed_batches", "streamed_summary", "streamed_counters", "streamed_sample", "judged_build", "live_preparation",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STORED))
def test_no_query_multiplies_rows(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "collect_list"):
        assert operator not in text


def test_hot_groups_are_aggregated_before_the_shuffle(spark, small):
    for name, partial in (("mean_pool", "partial_avg"), ("prep_counters", "partial_count"), ("max_batch_length", "partial_max")):
        text = plan(QUERIES[name](spark, small))
        assert partial in text, name


def exchanged(df) -> list[str]:
    """The columns that each exchange of a plan moves."""
    text = df._jdf.queryExecution().executedPlan().toString()
    found = df._jdf.queryExecution().executedPlan()
    nodes, out = [found], []
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.initialPlan())
            continue
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            out.append(node.output().mkString(" "))
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert out, text
    return out


def test_batch_lengths_move_no_sequence(spark, small):
    assert not any("input_ids" in moved for moved in exchanged(QUERIES["max_batch_length"](spark, small)))


def test_padding_moves_encoded_rows_and_no_built_column(spark, small):
    moved = exchanged(QUERIES["pad_batch"](spark, small))
    assert any("nano_layer_1" in m for m in moved)
    assert not any(c in m for m in moved for c in ("input_ids", "position_ids", "labels", "attention_mask", "text_tokens"))


def test_batches_of_a_stored_set_move_packed_tokens(spark, tmp_path):
    from voxloom.plans.training import batch_training_set

    ids = "transform(sequence(0, cast(id % 9 as int)), x -> 80000 - x)"
    rows = spark.range(60).selectExpr(
        "0 as source_idx", "cast(id as string) as row_key", f"{ids} as input_ids", "sequence(0, cast(id % 9 as int)) as position_ids"
    )
    made = batch_training_set(rows, batch_size=4)
    moved = exchanged(made)
    assert any("_ids" in m for m in moved)
    assert not any(c in m for m in moved for c in ("input_ids", "position_ids"))
    for r in made.collect():
        n = int(r.row_key) % 9 + 1
        assert r.input_ids[:n] == [80000 - x for x in range(n)] and r.position_ids[:n] == list(range(n))
        assert sum(r.attention_mask) == n and len(r.input_ids) == len(r.position_ids) == len(r.labels)


def test_packed_arrays_come_back(spark):
    from voxloom.functions.packing import PART_VALUES, packed, unpacked

    values = [[], None, [0], [3, -1, 2**31 - 1, -(2**31)], [5, None, 7], [None], list(range(5000)), [9] * (PART_VALUES // 2 + 1)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, values[-1]])], "i int, v array<int>").coalesce(1)
    for rising in (False, True):
        small = df.select("i", "v", packed("v", rising=rising).alias("p"))
        got = small.select("i", "v", F.length("p").alias("n"), unpacked("p").alias("back")).collect()
        assert all(r.v == r.back for r in got)
        assert max(r.n or 0 for r in got if r.i > 6) < 1000
    assert {r.i: r.n for r in got}[6] < 200  # as differences


def test_long_tables_are_small_on_disk(spark, tmp_path):
    import os

    import pyarrow.parquet as pq

    from voxloom.sources.writers import write_training_set

    rows = spark.range(4).selectExpr("id", "sequence(0, 20000 + cast(id as int)) as position_ids").coalesce(1)
    path = write_training_set(rows, str(tmp_path / "train"))
    files = [f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet")]
    assert sum(os.path.getsize(f) for f in files) < 8_000
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(1)
    assert column.compression == "ZSTD" and "DELTA_BINARY_PACKED" in column.encodings
    assert [r.position_ids for r in spark.read.parquet(path).orderBy("id").collect()] == [list(range(20001 + k)) for k in range(4)]


def test_codes_are_made_once_where_empty_ones_are_dropped(spark, small):
    optimized = QUERIES["drop_empty_codes"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("filter(arrays_zip(") == 1


@pytest.mark.parametrize("name", ["extract_text_span", "decode_sequences", "decode_sequences_detokenizer", "decode_sequences_odd_ids"])
def test_no_step_is_repeated_in_the_argument_of_a_detokenizer(spark, small, name):
    optimized = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert len(optimized) < 50_000


def test_decoded_samples_are_made_by_batch(spark, small):
    for name in ("prep_counters", "prepare_rejects"):
        assert "lambda" not in QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_results_do_not_depend_on_ansi_mode(spark):
    from voxloom.operators.sequences import rebuild_positions

    df = spark.createDataFrame([([64402, 64401, 5],)], "ids array<int>")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        out = rebuild_positions(df).select("position_ids", F.array_size("position_ids").alias("n")).first()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert out.position_ids is None and out.n is None
