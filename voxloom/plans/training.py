"""Encoded sources to a shuffled training set, and to padded batches."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.arrays import empty_ints
from voxloom.functions.frames import within_duration
from voxloom.functions.hashing import hash_bucket, order_hash
from voxloom.functions.packing import packed, unpacked
from voxloom.functions.sequences import ones_like, sequence_length
from voxloom.functions.text import Tokenizer
from voxloom.operators.batching import pad_to, sized_batches, with_batch_length
from voxloom.operators.frames import (
    add_codes,
    add_frames,
    build_errors,
    duration_filter,
    filter_report,
    require_sound,
)
from voxloom.operators.rows import union_sources
from voxloom.operators.sampling import SAMPLE_SEED, bucket_count, global_shuffle, subsample
from voxloom.operators.sequences import add_training_columns, tokenize_text, training_projection
from voxloom.session import delete_folder
from voxloom.sources.clustered import ClusteredTable
from voxloom.sources.readers import load_encoded
from voxloom.sources.writers import write_judged_set, write_training_set
from voxloom.specs import BuildRequest
from voxloom.vocab import DEFAULT_LAYOUT, LAYERS, TokenLayout

OnError = Literal["reject", "fail"]

ROW_KEY = ("source_idx", "row_key")


def checked_rows(df: DataFrame, *, max_seconds: float | None) -> DataFrame:
    """Rows of one source that are short enough, or of unknown length, with their build error."""
    if not max_seconds:
        return build_errors(df, length=None)
    length = F.col("encoded_len")
    return build_errors(df.where(length.isNull() | within_duration(length, max_seconds)))


def sound_rows(
    df: DataFrame,
    *,
    max_seconds: float | None,
    max_len: int | None = None,
    seed: int = SAMPLE_SEED,
    on_error: OnError = "reject",
) -> DataFrame:
    """Rows of one source that can be built, subsampled to ``max_len``."""
    if on_error == "fail":
        rows = require_sound(checked_rows(df, max_seconds=max_seconds))
    else:
        checked = build_errors(duration_filter(df, max_seconds), length=None)
        rows = checked.where(F.col("error").isNull()).drop("error")
    return subsample(rows, max_len, key=["row_key"], seed=seed)


def rejected_rows(df: DataFrame, *, max_seconds: float | None) -> DataFrame:
    """Key and reason of the rows of one source that cannot be built."""
    return checked_rows(df, max_seconds=max_seconds).where(F.col("error").isNotNull()).select("row_key", "error")


def build_parts(
    df: DataFrame, *, tokenizer: Tokenizer | None = None, layout: TokenLayout = DEFAULT_LAYOUT
) -> DataFrame:
    """Row-wise: ``text_tokens``, ``codes_list`` and ``num_audio_frames``."""
    coded = add_codes(add_frames(df), layout=layout)
    return tokenize_text(coded, tokenizer, layout=layout).drop("text", "speaker", "encoded_len")


def build_rows(
    df: DataFrame, *, tokenizer: Tokenizer | None = None, layout: TokenLayout = DEFAULT_LAYOUT
) -> DataFrame:
    """Row-wise: sound encoded rows to the four training columns, keys kept.

    No shuffle and no state, so it runs on a stream as it does on a table.
    """
    keys = [c for c in ROW_KEY if c in df.columns]
    parts = build_parts(df, tokenizer=tokenizer, layout=layout)
    return training_projection(add_training_columns(parts, layout), *keys)


def merged_sources(
    sources: Sequence[tuple[DataFrame, int | None]],
    *,
    max_seconds: float | None,
    seed: int = SAMPLE_SEED,
    on_error: OnError = "reject",
) -> DataFrame:
    """Sound rows of all ``(standard rows, max_len)`` sources, with their source index."""
    return union_sources(
        [
            sound_rows(df, max_seconds=max_seconds, max_len=max_len, seed=seed, on_error=on_error).withColumn(
                "source_idx", F.lit(i)
            )
            for i, (df, max_len) in enumerate(sources)
        ]
    )


def training_set(
    sources: Sequence[tuple[DataFrame, int | None]],
    *,
    max_seconds: float | None = 30,
    tokenizer: Tokenizer | None = None,
    layout: TokenLayout = DEFAULT_LAYOUT,
    seed: int = SAMPLE_SEED,
    on_error: OnError = "reject",
    partitions: int | None = None,
) -> DataFrame:
    """Sources filtered, subsampled, merged, shuffled and built.

    Building is row-wise, so it commutes with the shuffle.  Shuffling first
    moves the compact encoded rows instead of four long arrays per row.
    """
    rows = merged_sources(sources, max_seconds=max_seconds, seed=seed, on_error=on_error)
    shuffled = global_shuffle(rows, key=ROW_KEY, seed=seed, partitions=partitions)
    return build_rows(shuffled, tokenizer=tokenizer, layout=layout)


def judged_set(
    sources: Sequence[tuple[DataFrame, int | None]],
    *,
    max_seconds: float | None = 30,
    tokenizer: Tokenizer | None = None,
    layout: TokenLayout = DEFAULT_LAYOUT,
    seed: int = SAMPLE_SEED,
    on_error: OnError = "reject",
    partitions: int | None = None,
) -> DataFrame:
    """The rows of ``training_set``, and beside them the rejected ones with their ``error``.

    The partitions are those of the training set; in each the sound rows come first,
    in the order of the training set.  A rejected row moves without its payload.
    """
    found = []
    for i, (df, max_len) in enumerate(sources):
        rows = checked_rows(df, max_seconds=max_seconds)
        if on_error == "fail":
            rows = require_sound(rows).withColumn("error", F.lit(None).cast("string"))
        if max_len is not None:
            sample = subsample(rows.where(F.col("error").isNull()), max_len, key=["row_key"], seed=seed)
            rows = sample.unionByName(rows.where(F.col("error").isNotNull()))
        found.append(rows.withColumn("source_idx", F.lit(i)))
    rows = union_sources(found)
    sound = F.col("error").isNull()
    light = {layer: F.when(sound, F.col(layer)).otherwise(empty_ints()) for layer in LAYERS}
    rows = rows.withColumns(light | {"text": F.when(sound, F.col("text")).otherwise(F.lit(""))})
    n = partitions or bucket_count(rows)
    hashed = rows.withColumn("_h", order_hash(ROW_KEY, seed))
    placed = hashed.repartitionById(n, hash_bucket("_h", n)).sortWithinPartitions("error", "_h", *ROW_KEY)
    parts = build_parts(placed.drop("_h"), tokenizer=tokenizer, layout=layout)
    return training_projection(add_training_columns(parts, layout), *ROW_KEY, "error")


def batches(
    sources: Sequence[tuple[DataFrame, int | None]],
    *,
    batch_size: int,
    max_seconds: float | None = 30,
    tokenizer: Tokenizer | None = None,
    layout: TokenLayout = DEFAULT_LAYOUT,
    seed: int = SAMPLE_SEED,
    on_error: OnError = "reject",
    buckets: int | None = None,
) -> DataFrame:
    """The training set as padded batches: ``batch_id`` and the four columns.

    The bucket shuffle that ranks the rows is the global shuffle too: encoded
    rows move once, and sequences are built next to where they are padded.
    """
    rows = merged_sources(sources, max_seconds=max_seconds, seed=seed, on_error=on_error)
    sized = with_batch_length(
        rows,
        key=ROW_KEY,
        batch_size=batch_size,
        prepare=lambda df: build_parts(df, tokenizer=tokenizer, layout=layout),
        length=sequence_length("text_tokens", "num_audio_frames", layout),
        seed=seed,
        buckets=buckets,
    )
    padded = pad_to(add_training_columns(sized, layout), F.col("max_length"), layout=layout)
    return training_projection(padded, "batch_id", *ROW_KEY)


def batch_training_set(
    stored: DataFrame,
    *,
    batch_size: int,
    key: Sequence[str] = ROW_KEY,
    layout: TokenLayout = DEFAULT_LAYOUT,
    seed: int = SAMPLE_SEED,
    buckets: int | None = None,
) -> DataFrame:
    """Padded batches of a training set that has already been written.

    Ranking reads only the key columns of the stored table.  Labels and masks
    follow from the ids, so only ids and positions are shuffled, and these packed.
    """
    compact = stored.select(
        *key, F.array_size("input_ids").alias("_size"), packed("input_ids").alias("_ids"),
        packed("position_ids", rising=True).alias("_positions"),
    )
    sized = with_batch_length(compact, key=key, batch_size=batch_size, length=F.col("_size"), seed=seed, buckets=buckets)
    sized = sized.withColumns({"input_ids": unpacked("_ids"), "position_ids": unpacked("_positions")})
    full = sized.withColumn("labels", F.col("input_ids")).withColumn("attention_mask", ones_like("input_ids"))
    return training_projection(pad_to(full, F.col("max_length"), layout=layout), "batch_id", *key)


def clustered_rows(
    sources: Sequence[tuple[DataFrame, int | None]],
    table: ClusteredTable,
    *,
    max_seconds: float | None = 30,
    first_index: int = 0,
    on_error: OnError = "reject",
) -> ClusteredTable:
    """Add the sound, sampled rows of sources to a clustered table, numbered from ``first_index``; returns it."""
    for i, (df, max_len) in enumerate(sources, start=first_index):
        rows = sound_rows(df, max_seconds=max_seconds, max_len=max_len, seed=table.seed, on_error=on_error)
        table.add(rows.withColumn("source_idx", F.lit(i)))
    return table


def clustered_training_set(
    spark: SparkSession,
    table: ClusteredTable,
    *,
    tokenizer: Tokenizer | None = None,
    layout: TokenLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """The training set over a clustered table, with each row's ``rank`` in the shuffled order.  No row moves."""
    parts = build_parts(table.read(spark), tokenizer=tokenizer, layout=layout)
    return training_projection(add_training_columns(parts, layout), "rank", *ROW_KEY)


def clustered_batches(
    spark: SparkSession,
    table: ClusteredTable,
    *,
    batch_size: int,
    tokenizer: Tokenizer | None = None,
    layout: TokenLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """``batches`` over a clustered table: the same rows, and none of them moves."""
    sized = sized_batches(
        table.ranked(spark),
        batch_size=batch_size,
        prepare=lambda df: build_parts(df, tokenizer=tokenizer, layout=layout),
        length=sequence_length("text_tokens", "num_audio_frames", layout),
    )
    padded = pad_to(add_training_columns(sized, layout), F.col("max_length"), layout=layout)
    return training_projection(padded, "batch_id", *ROW_KEY)


def build_training_set(
    spark: SparkSession, request: BuildRequest, root: str, *, tokenizer: Tokenizer | None = None, **options
) -> DataFrame:
    """``training_set`` over the datasets that a request names below ``root``."""
    sources = [(load_encoded(spark, root, s), s.max_len) for s in request.sources]
    return training_set(sources, max_seconds=request.max_duration_sec, tokenizer=tokenizer, **options)


def make_batches(
    spark: SparkSession, request: BuildRequest, root: str, *, tokenizer: Tokenizer | None = None, **options
) -> DataFrame:
    """``batches`` over the datasets that a request names.

    Each batch has the per-device size and is padded on its own;
    ``step_id`` groups the batches that are accumulated into one update.
    """
    sources = [(load_encoded(spark, root, s), s.max_len) for s in request.sources]
    padded = batches(
        sources,
        batch_size=request.per_device_train_batch_size,
        max_seconds=request.max_duration_sec,
        tokenizer=tokenizer,
        **options,
    )
    return padded.withColumn("step_id", _step(request))


def _step(request: BuildRequest) -> Column:
    """The update step that a batch is accumulated into."""
    return F.floor(F.col("batch_id") / request.gradient_accumulation_steps).cast("bigint")


def run_build(
    spark: SparkSession,
    request: BuildRequest,
    root: str,
    output: str,
    *,
    tokenizer: Tokenizer | None = None,
    **options,
) -> DataFrame:
    """Write the training set and its rejects below ``output``; returns one report row per source.

    The report counts the rows a source has, those within the duration limit,
    those rejected, and those in the written training set.  Layers and texts are read
    once (and once more for a source with ``max_len``, to draw its sample): one job
    writes sound and rejected rows.  The counts come from the written tables and from
    a scan of the lengths alone, so they hold whatever tasks were run again.
    """
    out = output.rstrip("/")
    loaded = [load_encoded(spark, root, s) for s in request.sources]
    named = F.create_map(*[F.lit(x) for i, s in enumerate(request.sources) for x in (i, s.reponame)])
    judged = judged_set(
        [(df, s.max_len) for df, s in zip(loaded, request.sources)],
        max_seconds=request.max_duration_sec,
        tokenizer=tokenizer,
        **options,
    )
    train, failed = write_judged_set(judged, out)
    rejects = failed.select("row_key", "error", "source_idx", named[F.col("source_idx")].alias("reponame"))
    rejects.write.mode("overwrite").parquet(f"{out}/rejects")
    delete_folder(spark, f"{out}/parts")

    def counted(path: str, into: str) -> DataFrame:
        return spark.read.parquet(path).groupBy("source_idx").agg(F.count(F.lit(1)).alias(into))

    lengths = [
        filter_report(df, request.max_duration_sec).select(F.lit(i).alias("source_idx"), F.lit(s.reponame).alias("reponame"), "*")
        for i, (df, s) in enumerate(zip(loaded, request.sources))
    ]
    report = union_sources(lengths).join(counted(f"{out}/rejects", "rejected"), "source_idx", "left")
    report = report.join(counted(train, "built"), "source_idx", "left").fillna(0, ["rejected", "built"])
    return report.select("source_idx", "reponame", "rows_before", "rows_after", "rejected", "built")


def run_batches(
    spark: SparkSession,
    request: BuildRequest,
    root: str,
    output: str,
    *,
    tokenizer: Tokenizer | None = None,
    **options,
) -> DataFrame:
    """``run_build``, then the padded batches of the written set below ``output``.

    The sources are read and built once: ranking reads the key columns of the
    written training set.
    """
    report = run_build(spark, request, root, output, tokenizer=tokenizer, **options)
    stored = spark.read.parquet(f"{output.rstrip('/')}/train")
    padded = batch_training_set(
        stored,
        batch_size=request.per_device_train_batch_size,
        layout=options.get("layout", DEFAULT_LAYOUT),
        seed=options.get("seed", SAMPLE_SEED),
    )
    write_training_set(padded.withColumn("step_id", _step(request)), f"{output.rstrip('/')}/batches")
    return report
