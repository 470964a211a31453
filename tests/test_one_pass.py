from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.hashing import order_hash
from voxloom.plans import training
from voxloom.sources import readers, writers
from voxloom.specs import BuildRequest, EncodedSource
from voxloom.session import folder_names

from test_plans import plan
from test_sources import encoded


def published(spark, root, n=120):
    kind = F.col("id") % 10
    rows = encoded(spark, n).withColumn("nano_layer_2", F.when(kind != 3, F.col("nano_layer_2")))
    rows = rows.withColumn("text", F.when(kind != 4, F.col("text"))).withColumn("encoded_len", F.when(kind != 5, F.col("encoded_len")))
    rows = rows.withColumn("encoded_len", F.when(kind == 6, 9999).otherwise(F.col("encoded_len")))
    writers.publish_encoded(rows, root, "org/set")
    return [EncodedSource("org/set", key_column="id"), EncodedSource("org/set", key_column="id", speaker_id="Robin")]


def test_three_outputs_of_one_job(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    specs = published(spark, root)
    request = BuildRequest([*specs, EncodedSource("org/set", key_column="id", max_len=7)], max_duration_sec=30)
    for _ in range(2):  # the second run writes over the first
        report = {r.source_idx: r for r in training.run_build(spark, request, root, out, partitions=3).collect()}
    assert sorted(folder_names(spark, out)) == ["rejects", "train"]
    sources = [(readers.load_encoded(spark, root, s), s.max_len) for s in request.sources]
    direct = training.training_set(sources, max_seconds=30, partitions=3)
    written = spark.read.parquet(f"{out}/train")
    assert written.dtypes == direct.dtypes
    assert sorted(map(str, written.collect())) == sorted(map(str, direct.collect()))
    # Every file is a partition of the shuffled set, in its order.
    files = {}
    for row in written.select("*", order_hash(training.ROW_KEY, 42).alias("h"), F.input_file_name().alias("f")).collect():
        files.setdefault(row.f, []).append(row.h)
    assert len(files) == 3 and all(v == sorted(v) for v in files.values())
    rejects = spark.read.parquet(f"{out}/rejects")
    assert rejects.columns == ["row_key", "error", "source_idx", "reponame"]
    want = {(i, r.row_key, r.error) for i, (df, _) in enumerate(sources) for r in training.rejected_rows(df, max_seconds=30).collect()}
    assert {(r.source_idx, r.row_key, r.error) for r in rejects.collect()} == want
    assert {e for _, _, e in want} == {"null_layer", "null_text", "null_encoded_len"}
    counts = [(r.rows_before, r.rows_after, r.rejected, r.built) for _, r in sorted(report.items())]
    assert counts == [(120, 96, 36, 72), (120, 96, 36, 72), (120, 96, 36, 7)]


def test_layers_and_texts_are_scanned_once(spark, tmp_path):
    root = str(tmp_path)
    sources = [(readers.load_encoded(spark, root, s), None) for s in published(spark, root)]
    text = plan(training.judged_set(sources, max_seconds=30))
    assert text.count("FileScan parquet") == len(sources) and text.count("Exchange ") == 1
    assert "LessThanOrEqual(encoded_len,375)" in text
    # Rejected rows move without layers and text, and nothing is built before the shuffle.
    assert "input_ids" not in text.split("Exchange ", 1)[1]


def test_without_sound_or_without_rejected_rows(spark, tmp_path):
    root = str(tmp_path)
    bad = encoded(spark, 5).withColumn("nano_layer_1", F.lit(None).cast("array<int>"))
    writers.publish_encoded(bad, root, "org/bad")
    writers.publish_encoded(encoded(spark, 5), root, "org/good")
    writers.publish_encoded(encoded(spark, 5).limit(0), root, "org/none")
    for repo, built, rejected in (("org/bad", 0, 5), ("org/good", 5, 0), ("org/none", 0, 0)):
        request = BuildRequest([EncodedSource(repo, key_column="id")])
        out = f"{root}/out/{repo}"
        report = training.run_build(spark, request, root, out).first()
        assert (report.built, report.rejected) == (built, rejected)
        assert spark.read.parquet(f"{out}/train").count() == built and spark.read.parquet(f"{out}/rejects").count() == rejected
