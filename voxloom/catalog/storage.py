"""Tables written to the shared folder and read back, and the stream.

Each query writes below a new path of the folder that the session names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog.build import BATCH, MERGED_SQL, padded_digests, padded_sql, sources
from voxloom.catalog.fixtures import (
    BAD_ENCODED_SQL,
    ENCODED_SQL,
    MAX_SECONDS,
    damage_encoded,
    derived_layers,
    encoded,
    load_reshape_extractor,
    load_sum_encoder,
    md5_expr,
    raw_pcm_decoder,
    speakers,
    table,
)
from voxloom.catalog.preparation import (
    CHAT,
    DECODED,
    LOADER,
    PREPARED_COLUMNS,
    PREPARED_SQL,
    SPOKEN,
    decoded,
    prepared,
    prepared_digests,
    spoken,
)
from voxloom.catalog.registry import register
from voxloom.catalog.scoring import (
    COMPARED_SQL,
    REQUEST,
    ROUNDED_SQL,
    SCORES_SQL,
    eval_errors,
    generated,
    recordings,
    summary_sql,
)
from voxloom.catalog.sequences import BUILT_SQL, built
from voxloom.functions.arrays import digest, int_sum
from voxloom.functions.audio import AudioLoader
from voxloom.operators import report
from voxloom.plans import evaluation, preparation, training
from voxloom.session import COMPACT_ROWS, scratch_path, shuffle_partitions
from voxloom.sources import readers, writers
from voxloom.sources.clustered import ClusteredTable
from voxloom.specs import BuildRequest, CategoricalFilter, EncodedSource, PrepareRequest, merged_name
from voxloom.streaming.batches import StreamBatches
from voxloom.streaming.build import stream_rejects, stream_training_rows, write_available
from voxloom.streaming.status import RunStatus
from voxloom.streaming.totals import StreamSample, counter_totals, summary_totals
from voxloom.streaming.totals import streamed_counters as streamed_counters_of
from voxloom.streaming.totals import streamed_summary as streamed_summary_of
from voxloom.vocab import LAYERS, TRAINING_COLUMNS

LAYER_DIGESTS = ", ".join(f"{md5_expr(name)} AS {name}" for name in LAYERS)

# A dataset that names its columns in its own way.
OWN_NAMES = {**{name: f"codes_{k}" for k, name in enumerate(LAYERS)}, "encoded_len": "n_frames", "text": "sentence"}


# What ends a text file that stands for audio, and how many folders hold those of the documents.
END_OF_FILE = "\x00"
SHELVES = 256


def failing_decoder(data: bytes):
    raise ValueError("not my format")


def trimmed_decoder(data: bytes):
    """Raw samples without the byte that ends the file."""
    return raw_pcm_decoder(data.removesuffix(END_OF_FILE.encode()))


def _published(spark, sf, name: str) -> str:
    """The derived encoded rows as a dataset with its own column names; returns the root."""
    root = scratch_path(spark, name)
    own = encoded(spark, sf).withColumnsRenamed(OWN_NAMES)
    writers.publish_encoded(own, root, "corpora/documents")
    return root


def _spec(**more) -> EncodedSource:
    return EncodedSource(
        "corpora/documents",
        text_col_name=OWN_NAMES["text"],
        encoded_len=OWN_NAMES["encoded_len"],
        **{name: OWN_NAMES[name] for name in LAYERS},
        **more,
    )


@register(
    "load_encoded",
    f"""WITH {ENCODED_SQL} SELECT row_key, {LAYER_DIGESTS}, encoded_len, md5(text) AS text, speaker
    FROM encoded WHERE lang = 'en'""",
)
def load_encoded(spark, sf):
    """Publish, then read by a source description with a filter and renames."""
    spec = _spec(key_column="doc_id", categorical_filter=CategoricalFilter("lang", "en"))
    rows = readers.load_encoded(spark, _published(spark, sf, "load"), spec)
    return rows.select(
        "row_key", *[digest(n).alias(n) for n in LAYERS], "encoded_len", F.md5("text").alias("text"), "speaker"
    )


@register(
    "requested_training_set",
    f"""WITH {BUILT_SQL} SELECT {md5_expr("input_ids")} AS input_ids, {md5_expr("position_ids")} AS position_ids
    FROM built""",
)
def requested_training_set(spark, sf):
    """A build request over a published dataset without a key column."""
    request = BuildRequest([_spec()], max_duration_sec=MAX_SECONDS)
    rows = training.build_training_set(spark, request, _published(spark, sf, "request"))
    return rows.select(digest("input_ids").alias("input_ids"), digest("position_ids").alias("position_ids"))


@register(
    "batch_stored_set",
    f"""WITH {MERGED_SQL}, batched AS (
      SELECT *, (row_number() OVER (ORDER BY md5('42:' || source_idx || ':' || row_key), source_idx, row_key) - 1)
        // {BATCH} AS batch_id FROM built)
    {padded_sql("source_idx, row_key, batch_id", "batched")}""",
)
def batch_stored_set(spark, sf):
    """The training set written first, then batched from its table."""
    path = writers.write_training_set(
        training.training_set(sources(spark, sf), max_seconds=MAX_SECONDS), scratch_path(spark, "train")
    )
    return padded_digests(
        training.batch_training_set(spark.read.parquet(path), batch_size=BATCH), "source_idx", "row_key", "batch_id"
    )


@register(
    "judged_build",
    f"""WITH {MERGED_SQL}
    SELECT source_idx, row_key, CAST(NULL AS VARCHAR) AS error, {md5_expr("input_ids")} AS input_ids,
           {md5_expr("position_ids")} AS position_ids FROM built
    UNION ALL
    SELECT 1, row_key, error, NULL, NULL FROM checked
    WHERE error IS NOT NULL AND (encoded_len IS NULL OR encoded_len / 12.5 <= 30)""",
)
def judged_build(spark, sf):
    """Training rows and rejected rows written by one job, and read back."""
    judged = training.judged_set(sources(spark, sf), max_seconds=MAX_SECONDS)
    train, rejects = writers.write_judged_set(judged, scratch_path(spark, "judged"))
    built_rows = spark.read.parquet(train).select(
        "source_idx", "row_key", F.lit(None).cast("string").alias("error"),
        digest("input_ids").alias("input_ids"), digest("position_ids").alias("position_ids"),
    )
    none = [F.lit(None).cast("string").alias(c) for c in ("input_ids", "position_ids")]
    return built_rows.unionByName(rejects.select("source_idx", "row_key", "error", *none))


RANKED_SQL = f"""{MERGED_SQL}, ranked AS (
      SELECT *, row_number() OVER (ORDER BY md5('42:' || source_idx || ':' || row_key), source_idx, row_key) - 1 AS rank FROM built)"""


def _clustered(spark, sf, name):
    """The two sources in one table, the second added to the first."""
    table_ = ClusteredTable(scratch_path(spark, name), training.ROW_KEY, 12)
    for i, source in enumerate(sources(spark, sf)):
        training.clustered_rows([source], table_, max_seconds=MAX_SECONDS, first_index=i)
    return table_


@register(
    "clustered_training_set",
    f"""WITH {RANKED_SQL}
    SELECT rank, source_idx, row_key, {md5_expr("input_ids")} AS input_ids, {md5_expr("position_ids")} AS position_ids FROM ranked""",
)
def clustered_training_set(spark, sf):
    """Two sources added one after the other to a table stored by hash ranges, then built in order, unmoved."""
    rows = training.clustered_training_set(spark, _clustered(spark, sf, "clustered-set"))
    return rows.select("rank", "source_idx", "row_key", digest("input_ids").alias("input_ids"), digest("position_ids").alias("position_ids"))


@register(
    "clustered_batches",
    f"""WITH {RANKED_SQL}, batched AS (SELECT *, rank // {BATCH} AS batch_id FROM ranked)
    {padded_sql("source_idx, row_key, batch_id", "batched")}""",
)
def clustered_batches(spark, sf):
    """Padded batches of the same table, cut where the rows lie."""
    rows = training.clustered_batches(spark, _clustered(spark, sf, "clustered-batches"), batch_size=BATCH)
    return padded_digests(rows, "source_idx", "row_key", "batch_id")


@register(
    "build_report",
    f"""WITH {BUILT_SQL}
    SELECT 0 AS source_idx, 'corpora/documents' AS reponame, (SELECT count(*) FROM documents) AS rows_before,
           count(*) AS rows_after, CAST(0 AS BIGINT) AS rejected, count(*) AS built FROM built
    UNION ALL
    SELECT 1, 'corpora/documents', count(*) FILTER (lang = 'en'),
           count(*) FILTER (lang = 'en' AND encoded_len / 12.5 <= 30), 0,
           least(100, count(*) FILTER (lang = 'en' AND encoded_len / 12.5 <= 30)) FROM encoded""",
)
def build_report(spark, sf):
    """A whole build run over two stored sources, one filtered and sampled."""
    root = _published(spark, sf, "run")
    english = CategoricalFilter("lang", "en")
    request = BuildRequest(
        [_spec(key_column="doc_id"), _spec(key_column="doc_id", categorical_filter=english, max_len=100)],
        max_duration_sec=MAX_SECONDS,
    )
    return training.run_build(spark, request, root, f"{root}/built")


def _padded_sql(values: str, pad: int) -> str:
    return md5_expr(f"{values} || list_transform(range(len(input_ids), max(len(input_ids)) OVER (PARTITION BY batch_id)), lambda x: {pad})")


REQUESTED_SQL = f"""SELECT source_idx, row_key, batch_id, batch_id // 3 AS step_id, CAST(len(input_ids) AS INT) AS n_tokens,
           CAST(max(len(input_ids)) OVER (PARTITION BY batch_id) AS INT) AS padded_length,
           {_padded_sql("input_ids", 64407)} AS input_ids, {_padded_sql("input_ids", -100)} AS labels,
           {_padded_sql("position_ids", 0)} AS position_ids"""


@register(
    "requested_batches",
    f"""WITH {BUILT_SQL}, batched AS (
      SELECT 0 AS source_idx, *,
        (row_number() OVER (ORDER BY md5('42:0:' || row_key), row_key) - 1) // 4 AS batch_id FROM built)
    {REQUESTED_SQL}
    FROM batched""",
)
def requested_batches(spark, sf):
    """Batches of a build request: padded per device batch, grouped into update steps."""
    request = BuildRequest(
        [_spec(key_column="doc_id")],
        max_duration_sec=MAX_SECONDS,
        per_device_train_batch_size=4,
        gradient_accumulation_steps=3,
    )
    return _batch_digests(training.make_batches(spark, request, _published(spark, sf, "batches")))


def _batch_digests(rows):
    return rows.select(
        "source_idx", "row_key", "batch_id", "step_id",
        int_sum("attention_mask").cast("int").alias("n_tokens"), F.array_size("labels").alias("padded_length"),
        *[digest(c).alias(c) for c in ("input_ids", "labels", "position_ids")],
    )


@register(
    "run_batches",
    f"""WITH {BUILT_SQL}, batched AS (
      SELECT 0 AS source_idx, *,
        (row_number() OVER (ORDER BY md5('42:0:' || row_key), row_key) - 1) // 4 AS batch_id FROM built)
    {REQUESTED_SQL}
    FROM batched""",
)
def run_batches(spark, sf):
    """A whole run: the training set written, then its batches written and read back."""
    root = _published(spark, sf, "run-batches")
    request = BuildRequest(
        [_spec(key_column="doc_id")],
        max_duration_sec=MAX_SECONDS,
        per_device_train_batch_size=4,
        gradient_accumulation_steps=3,
    )
    training.run_batches(spark, request, root, f"{root}/built")
    return _batch_digests(spark.read.parquet(f"{root}/built/batches"))


@register(
    "run_preparation",
    f"""WITH {PREPARED_SQL}
    SELECT 'merged' AS kind, CAST(NULL AS VARCHAR) AS source, md5(text) AS text_md5, speaker, encoded_len, {md5_expr("nano_layer_4")} AS last_layer,
           CAST(NULL AS VARCHAR) AS error
    FROM prepared WHERE error IS NULL AND source <> '{CHAT.dataset_name}'
    UNION ALL
    SELECT 'reject', source, md5(text), speaker, NULL, NULL, error FROM prepared
    WHERE error IS NOT NULL AND source <> '{CHAT.dataset_name}'
    UNION ALL
    SELECT 'published', NULL, md5(text), speaker, encoded_len, {md5_expr("nano_layer_4")}, NULL
    FROM prepared WHERE error IS NULL AND source <> '{CHAT.dataset_name}'
    UNION ALL
    SELECT 'counted', source, CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (error IS NULL) AS VARCHAR),
           CAST(count(*) FILTER (error IS NOT NULL) AS INT), NULL, NULL
    FROM prepared WHERE source <> '{CHAT.dataset_name}' GROUP BY source""",
)
def run_preparation(spark, sf):
    """A whole run over two stored sources: merged JSON, published dataset, rejects and counters, read back."""
    root = scratch_path(spark, "run-preparation")
    writers.publish_encoded(spoken(spark, sf), root, SPOKEN.dataset_name, "train")
    writers.publish_encoded(decoded(spark, sf), root, DECODED.dataset_name, "train")
    request = PrepareRequest([SPOKEN, DECODED], f"{root}/out", "speech/all")
    preparation.run_preparation(spark, request, root, load_sum_encoder, loader=LOADER)
    name = merged_name([], "speech/all")
    none = F.lit(None).cast("string")

    def rows(kind, df, source):
        return df.select(
            F.lit(kind).alias("kind"), source.alias("source"), F.md5("text").alias("text_md5"), "speaker", "encoded_len",
            digest("nano_layer_4").alias("last_layer"), none.alias("error"),
        )

    merged = readers.read_merged_json(spark, f"{root}/out/{name}")
    rejects = spark.read.parquet(f"{root}/out/rejects/{name}").select(
        F.lit("reject").alias("kind"), "source", F.md5("text").alias("text_md5"), "speaker",
        F.lit(None).cast("int").alias("encoded_len"), none.alias("last_layer"), "error",
    )
    counters = spark.read.parquet(f"{root}/out/counters/{name}").where("source is not null").select(
        F.lit("counted").alias("kind"), "source", F.col("total").cast("string").alias("text_md5"),
        F.col("processed").cast("string").alias("speaker"), F.col("failed_samples").cast("int").alias("encoded_len"),
        none.alias("last_layer"), none.alias("error"),
    )
    published = readers.load_dataset(spark, f"{root}/out", "speech/all")
    return rows("merged", merged, none).unionByName(rejects).unionByName(rows("published", published, none)).unionByName(counters)


@register(
    "live_preparation",
    f"""WITH {PREPARED_SQL}, done AS (
      SELECT count(*) FILTER (source = '{SPOKEN.dataset_name}') AS first_total,
             count(*) FILTER (source = '{SPOKEN.dataset_name}' AND error IS NOT NULL) AS first_failed,
             count(*) AS total, count(*) FILTER (error IS NOT NULL) AS failed
      FROM prepared WHERE source <> '{CHAT.dataset_name}')
    SELECT 'starting' AS status, 0 AS datasets_done, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS processed,
           CAST(0 AS BIGINT) AS failed_samples
    UNION ALL SELECT 'running', 0, first_total, first_total - first_failed, first_failed FROM done
    UNION ALL SELECT 'running', 1, total, total - failed, failed FROM done
    UNION ALL SELECT 'completed', 2, total, total - failed, failed FROM done""",
)
def live_preparation(spark, sf):
    """The status that a run over two stored sources leaves, the last row of each of its parts."""
    root = scratch_path(spark, "live-preparation")
    writers.publish_encoded(spoken(spark, sf).repartition(3), root, SPOKEN.dataset_name, "train")
    writers.publish_encoded(decoded(spark, sf).repartition(2), root, DECODED.dataset_name, "train")
    request = PrepareRequest([SPOKEN, DECODED], f"{root}/out", "speech/all")
    preparation.prepare_live(spark, request, root, load_sum_encoder, f"{root}/live", files_per_step=2, loader=LOADER)
    rows = RunStatus(spark, f"{root}/live/status").read()
    values = F.struct("number", "total", "processed", "failed_samples")
    last = rows.groupBy("status", "datasets_done").agg(F.max(values).alias("last"))
    return last.select("status", "datasets_done", "last.total", "last.processed", "last.failed_samples")


@register(
    "prepare_audio_files",
    f"""WITH {PREPARED_SQL}
    SELECT md5(text) AS text_md5, speaker, error, encoded_len, {md5_expr("nano_layer_1")} AS first_layer
    FROM (SELECT text, CASE WHEN speaker IS NULL THEN NULL ELSE speaker END AS speaker,
            CASE WHEN error IS NULL THEN NULL ELSE 'missing_audio' END AS error, encoded_len, nano_layer_1
          FROM prepared WHERE source = '{SPOKEN.dataset_name}' AND text <> '')""",
)
def prepare_audio_files(spark, sf):
    """Audio read as files: every document's text is a file of bytes, every 25th is missing."""
    root = scratch_path(spark, "files")
    docs = table(spark, sf, "documents").where(F.length("text") > 0)
    there = docs.where(F.col("doc_id") % 25 != 0)
    # One file per document: a partition per id, the text as its only bytes.  Every core writes, however
    # few files the table has; the folders lie on shelves, so that a task lists a shelf and not a few of them.
    named = there.select(F.pmod("doc_id", F.lit(SHELVES)).alias("shelf"), "doc_id", F.col("text").alias("value"))
    spread = named.repartition(shuffle_partitions(spark), "shelf")
    spread.write.partitionBy("shelf", "doc_id").option("lineSep", END_OF_FILE).text(f"{root}/audio")
    files = readers.load_audio_files(spark, f"{root}//audio/.")
    key = F.regexp_extract("file", r"^shelf=\d+/doc_id=(\d+)/", 1)
    codes = files.select(key.alias("file"), "audio")
    loader = AudioLoader(decoders=(failing_decoder, trimmed_decoder))
    transcripts = docs.select(F.col("doc_id").cast("string").alias("file"), "text", "source")
    out = preparation.prepare_audio_files(codes, transcripts, SPOKEN, load_sum_encoder, loader=loader)
    return out.select(
        F.md5("text").alias("text_md5"), "speaker", "error", "encoded_len", digest("nano_layer_1").alias("first_layer")
    )


@register(
    "merged_json",
    f"""WITH {PREPARED_SQL} SELECT md5(text) AS text, speaker, encoded_len, {LAYER_DIGESTS}
    FROM prepared WHERE error IS NULL""",
)
def merged_json(spark, sf):
    """The merged JSON output, read back."""
    sound, _ = report.split_rejects(prepared(spark, sf))
    path = writers.write_merged_json(sound, scratch_path(spark, "json"), ["speech/docs-bytes", "speech/chat"])
    rows = readers.read_merged_json(spark, path)
    return rows.select(
        F.md5("text").alias("text"), "speaker", "encoded_len", *[digest(n).alias(n) for n in LAYERS]
    )


@register(
    "load_raw_audio",
    """
    SELECT doc_id AS key, CASE WHEN doc_id % 25 <> 0 THEN md5(encode(text)) END AS bytes_md5,
           'doc-' || doc_id || '.raw' AS path, md5(text) AS text_md5, source
    FROM documents
    """,
)
def load_raw_audio(spark, sf):
    """Raw audio rows written and read back, still undecoded."""
    root = scratch_path(spark, "raw")
    writers.publish_encoded(spoken(spark, sf), root, "speech/docs-bytes", "train")
    rows = readers.load_raw_audio(spark, root, "speech/docs-bytes")
    return rows.select(
        "key", F.md5("audio.bytes").alias("bytes_md5"), F.col("audio.path").alias("path"),
        F.md5("text").alias("text_md5"), "source",
    )


@register(
    "publish_prepared",
    f"WITH {PREPARED_SQL} SELECT {PREPARED_COLUMNS} FROM prepared WHERE error IS NULL",
)
def publish_prepared(spark, sf):
    """The encoded dataset published as Parquet and loaded again."""
    root = scratch_path(spark, "publish")
    sound, _ = report.split_rejects(prepared(spark, sf))
    writers.publish_encoded(sound, root, "speech/merged")
    return prepared_digests(readers.load_dataset(spark, root, "speech/merged"))


@register(
    "evaluation_results",
    f"WITH RECURSIVE {COMPARED_SQL} {summary_sql('evaluated')}",
)
def evaluation_results(spark, sf):
    """A whole evaluation run over stored recordings: rows and summary written."""
    root = scratch_path(spark, "evaluate")
    writers.publish_encoded(recordings(spark, sf), root, REQUEST.dataset_name, REQUEST.split)
    return evaluation.run_evaluation(
        spark, REQUEST, root, generated(spark, sf), load_reshape_extractor, f"{root}/scores"
    )


def _document_stream(spark, sf):
    """The documents as they arrive, as encoded rows; the table is one file or a folder of files."""
    # A pattern, because a stream takes a plain path for a folder.
    stream = spark.readStream.schema(table(spark, sf, "documents").schema).parquet(f"{sf}/documents.parque[t]")
    return derived_layers(speakers(stream))


@register(
    "streamed_rejects",
    f"""WITH {BAD_ENCODED_SQL} SELECT row_key, error FROM checked
    WHERE error IS NOT NULL AND (encoded_len IS NULL OR encoded_len / 12.5 <= 30)""",
)
def streamed_rejects(spark, sf):
    """Rows that a stream leaves out, with their reasons, in a sink of their own."""
    out = scratch_path(spark, "stream-rejects")
    rejects = stream_rejects(damage_encoded(_document_stream(spark, sf)), max_seconds=MAX_SECONDS)
    write_available(rejects, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("row_key", "error")


@register(
    "streamed_training_rows",
    f"""WITH {BUILT_SQL} SELECT row_key, {md5_expr("input_ids")} AS input_ids, {md5_expr("input_ids")} AS labels,
           {md5_expr("list_transform(input_ids, lambda x: 1)")} AS attention_mask,
           {md5_expr("position_ids")} AS position_ids
    FROM built""",
)
def streamed_training_rows(spark, sf):
    """The documents as a stream, built row by row into a Parquet sink."""
    out = scratch_path(spark, "stream")
    rows = stream_training_rows(_document_stream(spark, sf), max_seconds=MAX_SECONDS)
    write_available(rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    built = spark.read.parquet(f"{out}/rows")
    return built.select("row_key", *[digest(c).alias(c) for c in TRAINING_COLUMNS])


# Batches of rows that arrive in three parts, each a run of the stream; 32 rows are shuffled at a time.
STREAM_BATCH, STREAM_RUN = 8, 32


@register(
    "streamed_batches",
    f"""WITH {BUILT_SQL},
    numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM built),
    placed AS (
      SELECT *, i // {STREAM_RUN} * {STREAM_RUN}
        + row_number() OVER (PARTITION BY i // {STREAM_RUN} ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM numbered),
    batched AS (SELECT *, place // {STREAM_BATCH} AS batch_id FROM placed)
    {padded_sql("doc_id, batch_id", "batched")}""",
)
def streamed_batches(spark, sf):
    """The training rows come in three parts, the stream stopping after each; batches go on where they ended."""
    place = scratch_path(spark, "stream-batches")
    rows = built(spark, sf).select("doc_id", *TRAINING_COLUMNS)
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    batches = StreamBatches(f"{place}/set", STREAM_BATCH, key=["doc_id"], order=["doc_id"], shuffle_rows=STREAM_RUN)
    for part in range(3):
        here = F.floor((F.col("doc_id") - low) * 3 / F.lit(high - low + 1)) == part
        rows.where(here).write.mode("append").options(**COMPACT_ROWS).parquet(f"{place}/inbox")
        stream = spark.readStream.schema(rows.schema).parquet(f"{place}/inbox")
        batches.run(stream, f"{place}/checkpoint").awaitTermination()
    return padded_digests(batches.read(spark, with_open=True), "doc_id", "batch_id")


def _in_three_parts(spark, rows, place, taken, key):
    """Rows that arrive in three parts, by a hash of their key, a stream stopping after each."""
    rows.write.parquet(f"{place}/all")
    whole = spark.read.schema(rows.schema).parquet(f"{place}/all")
    for part in range(3):
        here = F.pmod(F.xxhash64(*key), F.lit(3)) == part
        whole.where(here).write.mode("append").parquet(f"{place}/inbox")
        stream = spark.readStream.schema(rows.schema).parquet(f"{place}/inbox")
        taken.run(stream, f"{place}/checkpoint").awaitTermination()
    return taken.read(spark)


@register(
    "streamed_summary",
    f"WITH {SCORES_SQL}, rounded AS (SELECT sample_index, {ROUNDED_SQL} FROM weighted) {summary_sql('rounded')}",
)
def streamed_summary(spark, sf):
    """The evaluation summary of samples that arrive in three parts."""
    place = scratch_path(spark, "stream-summary")
    totals = _in_three_parts(spark, eval_errors(spark, sf), place, summary_totals(f"{place}/state"), ["sample_index"])
    return streamed_summary_of(totals)


@register(
    "streamed_counters",
    f"""WITH {PREPARED_SQL}
    SELECT source, count(*) AS total, count(*) FILTER (error IS NULL) AS processed,
           count(*) FILTER (error IS NOT NULL) AS failed_samples
    FROM prepared GROUP BY ROLLUP (source)""",
)
def streamed_counters(spark, sf):
    """The counters of Prepare over rows that arrive in three parts."""
    place = scratch_path(spark, "stream-counters")
    rows = prepared(spark, sf).select("source", "row_key", "error")
    totals = _in_three_parts(spark, rows, place, counter_totals(f"{place}/state"), ["source", "row_key"])
    return streamed_counters_of(totals)


@register(
    "streamed_sample",
    "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 150",
)
def streamed_sample(spark, sf):
    """The sample of documents that arrive in three parts is the sample of all of them."""
    place = scratch_path(spark, "stream-sample")
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("text_md5"))
    return _in_three_parts(spark, docs, place, StreamSample(f"{place}/state", 150, ["doc_id"]), ["doc_id"])
