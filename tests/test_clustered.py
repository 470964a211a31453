from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from voxloom.functions.hashing import order_hash
from voxloom.plans import training
from voxloom.sources.clustered import ClusteredTable

from test_plans import plan
from test_sources import encoded


def standard(df):
    return df.withColumn("row_key", F.col("id").cast("string")).drop("id")


def source(spark, n, first=0):
    return standard(encoded(spark, n).withColumn("id", F.col("id") + first))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    made = ClusteredTable(f"{tmp_path}/set", training.ROW_KEY, 6)
    return training.clustered_rows([(source(spark, 150), None)], made)


def texts(df):
    return sorted(map(str, df.collect()))


def test_adding_a_source_rewrites_nothing(spark, table):
    before = files(table.path)
    training.clustered_rows([(source(spark, 90, 1000), 60)], table, first_index=1)
    after = files(table.path)
    assert before.items() <= after.items() and len(after) > len(before)
    both = [(source(spark, 150), None), (source(spark, 90, 1000), 60)]
    built = training.clustered_training_set(spark, table)
    assert texts(built.drop("rank")) == texts(training.training_set(both))
    rows = built.select("rank", *training.ROW_KEY, order_hash(training.ROW_KEY, 42).alias("h")).collect()
    assert [r["rank"] for r in rows] == list(range(210)), "partition by partition, the rows are in the shuffled order"
    assert [r.h for r in rows] == sorted(r.h for r in rows)
    assert texts(training.clustered_batches(spark, table, batch_size=8)) == texts(training.batches(both, batch_size=8))


def payload_exchanges(df):
    """Exchanges whose rows, as the operator below them puts them out, hold a layer, codes or a sequence."""
    df.collect()
    lines = plan(df).split("== Initial Plan ==")[0].splitlines()
    pairs = [(line, below) for line, below in zip(lines, lines[1:]) if "Exchange " in line and "ReusedExchange" not in line]
    return [line for line, below in pairs if any(c in below for c in ("nano_layer", "input_ids", "codes_list", "frames"))]


def test_no_payload_moves(spark, table, tmp_path):
    source(spark, 20).write.parquet(f"{tmp_path}/plain")
    plain = spark.read.parquet(f"{tmp_path}/plain")
    assert payload_exchanges(training.training_set([(plain, None)]))  # the probe works
    for df in (training.clustered_training_set(spark, table), training.clustered_batches(spark, table, batch_size=8)):
        assert payload_exchanges(df) == []
        assert "Bucketed: true" in plan(df)


def test_another_session_finds_the_table(spark, table):
    fresh = ClusteredTable.at(spark, table.path)
    assert fresh == ClusteredTable(table.path, training.ROW_KEY, 6)
    spark.sql(f"DROP TABLE {table._name(spark)}")  # as a session that has not seen it; the files stay
    assert fresh.read(spark).count() == 150
    other = spark.newSession()
    training.clustered_rows([(source(other, 10, 5000), None)], ClusteredTable.at(other, table.path), first_index=1)
    assert fresh.read(spark).count() == 160
    assert fresh.read(spark).agg(F.max("rank"), F.count_distinct("rank")).first()[:] == (159, 160)


def test_settings_are_checked(spark, table, tmp_path):
    with pytest.raises(ValueError, match="other settings"):
        training.clustered_rows([(source(spark, 5), None)], ClusteredTable(table.path, training.ROW_KEY, 7))
    with pytest.raises(ValueError, match="at least 1"):
        ClusteredTable(f"{tmp_path}/none", ["row_key"], 0).add(source(spark, 5))
    empty = ClusteredTable(f"{tmp_path}/empty", training.ROW_KEY, 3)
    training.clustered_rows([(source(spark, 5).limit(0), None)], empty)
    assert training.clustered_batches(spark, empty, batch_size=8).count() == 0


@pytest.mark.parametrize("buckets", [1, 2, 37])
def test_every_bucket_has_its_slot(spark, tmp_path, buckets):
    slots = ClusteredTable(str(tmp_path), ["k"], buckets)._slots(spark)
    found = {r._bucket: r._b for r in slots.collect()}
    assert sorted(found) == list(range(buckets))
    check = slots.where(F.pmod(F.hash("_b"), F.lit(buckets)) != F.col("_bucket"))
    assert check.count() == 0
