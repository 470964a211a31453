from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxloom.plans.training import build_rows, sound_rows
from voxloom.session import scratch_path
from voxloom.sources import readers
from voxloom.specs import EncodedSource
from voxloom.streaming.build import stream_training_rows, write_available

from test_sources import encoded


def rows_of(df):
    return sorted((r.row_key, tuple(r.input_ids), tuple(r.position_ids)) for r in df.collect())


def test_stream_equals_batch_and_continues(spark, tmp_path):
    spec = EncodedSource("unused", key_column="id")
    inbox, out, checkpoint = (f"{tmp_path}/{n}" for n in ("inbox", "out", "checkpoint"))
    encoded(spark, 20).write.parquet(inbox)
    schema = spark.read.parquet(inbox).schema

    def run():
        stream = readers.standard_columns(spark.readStream.schema(schema).parquet(inbox), spec)
        write_available(stream_training_rows(stream, max_seconds=30), out, checkpoint).awaitTermination()
        return rows_of(spark.read.parquet(out))

    def batch():
        return rows_of(build_rows(sound_rows(readers.standard_columns(spark.read.parquet(inbox), spec), max_seconds=30)))

    assert run() == batch()
    encoded(spark, 5).withColumn("id", F.col("id") + 100).write.mode("append").parquet(inbox)
    assert len(run()) == 25
    assert run() == batch()


def test_scratch_paths_lie_in_the_shared_folder(spark):
    from voxloom.session import shared_dir

    a, b = scratch_path(spark, "t"), scratch_path(spark, "t")
    assert a != b and a.startswith(shared_dir(spark))


def test_a_cluster_may_name_its_shared_folder_without_a_scheme(spark, tmp_path):
    from types import SimpleNamespace

    from voxloom.session import shared_dir

    def session(**conf):
        context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=conf, sparkContext=context, _jvm=spark._jvm, _jsc=spark._jsc)

    named = {"spark.checkpoint.dir": f"{tmp_path}/shared/"}
    assert shared_dir(session(**named)) == f"file:{tmp_path}/shared"
    assert shared_dir(session(**{"spark.checkpoint.dir": "hdfs://store/shared"})) == "hdfs://store/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session())


def test_a_stream_reads_a_table_of_several_files(spark, small, tmp_path):
    from voxloom.catalog import QUERIES

    spark.read.parquet(f"{small}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("streamed_rejects", "streamed_training_rows"):
        expected = QUERIES[name](spark, small).collect()
        assert sorted(QUERIES[name](spark, str(tmp_path)).collect()) == sorted(expected)


def test_a_stream_writes_row_groups_that_a_reader_can_hold(spark, tmp_path):
    import pyarrow.parquet as pq

    from voxloom.session import LONG_ROWS

    rows = spark.range(1000).select("id", F.array_repeat(F.col("id").cast("int"), 50).alias("input_ids"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    write_available(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    (file,) = (tmp_path / "out").glob("part-*.parquet")
    stored = pq.ParquetFile(file).metadata
    groups = [stored.row_group(i).num_rows for i in range(stored.num_row_groups)]
    assert sum(groups) == 1000 and max(groups) <= 128
    assert all(spark.conf.get(key, None) is None for key in LONG_ROWS)
