"""Datasets as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.operators.rows import categorical_filter, rename_columns
from voxloom.specs import EncodedSource
from voxloom.vocab import LAYERS

ENCODED_SCHEMA = (
    ", ".join(f"{layer} array<int>" for layer in LAYERS) + ", encoded_len int, text string, speaker string"
)

# Copies of the per-file offsets when they are joined, so that no file's rows meet in one task.
FILE_SALTS = 16


def dataset_path(root: str, repo: str, name: str | None, split: str) -> str:
    return "/".join(p for p in (root.rstrip("/"), repo, name, split) if p)


def load_dataset(
    spark: SparkSession,
    root: str,
    repo: str,
    *,
    name: str | None = None,
    split: str = "train",
    fmt: str = "parquet",
    schema: str | None = None,
) -> DataFrame:
    """``root/repo[/name]/split`` in the given format."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(dataset_path(root, repo, name, split))


def _json_schema(source: EncodedSource) -> str:
    """The columns a source names; stating them saves the pass that would infer them."""
    columns = {getattr(source, layer): "array<int>" for layer in LAYERS}
    columns |= {source.encoded_len: "int", source.text_col_name: "string", "speaker": "string"}
    if source.key_column is not None:
        columns.setdefault(source.key_column, "string")
    if source.categorical_filter is not None:
        columns.setdefault(source.categorical_filter.column_name, "string")
    return ", ".join(f"`{c}` {t}" for c, t in columns.items())


def load_encoded(spark: SparkSession, root: str, source: EncodedSource) -> DataFrame:
    """One encoded dataset with a row key, filtered and in standard column names."""
    df = load_dataset(
        spark,
        root,
        source.reponame,
        name=source.name,
        split=source.split,
        fmt=source.format,
        schema=_json_schema(source) if source.format == "json" else None,
    )
    if source.key_column is None:
        df = df.withColumn(
            "row_key", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index")
        )
    return standard_columns(df, source)


def standard_columns(df: DataFrame, source: EncodedSource) -> DataFrame:
    """Filter on the source's own columns, then rename, and settle key and speaker."""
    if source.categorical_filter is not None:
        df = categorical_filter(df, source.categorical_filter.column_name, source.categorical_filter.value)
    if source.key_column is not None:
        df = df.withColumn("row_key", F.col(source.key_column).cast("string"))
    df = rename_columns(df, source.renames)
    if source.speaker_id is not None:
        df = df.withColumn("speaker", F.lit(source.speaker_id))
    elif "speaker" not in df.columns:
        df = df.withColumn("speaker", F.lit(None).cast("string"))
    codes = [F.col(layer).cast("array<int>").alias(layer) for layer in LAYERS]
    return df.select("row_key", *codes, "encoded_len", "text", "speaker")


def load_raw_audio(spark: SparkSession, root: str, repo: str, *, split: str = "train", fmt: str = "parquet") -> DataFrame:
    """Raw audio rows; the bytes stay undecoded until the encoding job needs them."""
    return load_dataset(spark, root, repo, split=split, fmt=fmt)


def with_place(df: DataFrame) -> DataFrame:
    """Add ``_file`` and ``_row``, where a row of a Parquet dataset is stored; ``df`` must come straight
    from the reader."""
    return df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))


def file_offsets(df: DataFrame) -> DataFrame:
    """``(_file, _offset)``: how many rows the files before each one hold; one row per file, by name."""
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = with_place(df).groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    return files.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))


def attach_sample_index(placed: DataFrame, offsets: DataFrame, into: str = "sample_index") -> DataFrame:
    """Number rows that kept ``_file`` and ``_row``: the rows of all files before, plus the place in the file.

    Rows may be shuffled for it, so attach numbers to what was made of large
    values rather than to the values themselves.
    """
    copies = offsets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(FILE_SALTS - 1))))
    salted = placed.withColumn("_salt", F.pmod("_row", F.lit(FILE_SALTS)).cast("int"))
    numbered = salted.join(copies, ["_file", "_salt"]).withColumn(into, F.col("_offset") + F.col("_row"))
    return numbered.drop("_file", "_row", "_offset", "_salt")


def with_sample_index(df: DataFrame, into: str = "sample_index") -> DataFrame:
    """Number the rows of a Parquet dataset 0, 1, … in file and row order.

    ``df`` must come straight from the reader and hold no large values; for those,
    see ``attach_sample_index``.
    """
    return attach_sample_index(with_place(df), file_offsets(df), into)


def qualified(spark: SparkSession, path: str) -> str:
    """A folder as Spark prints it, up to its first pattern: with scheme, absolute, single slashes."""
    plain = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    if plain != path:
        plain = plain.rsplit("/", 1)[0] if "/" in plain else "."
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(plain or "/")
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(hadoop).toString().rstrip("/")


def load_audio_files(spark: SparkSession, path: str, *, glob: str = "*", into: str = "audio") -> DataFrame:
    """Audio files below ``path``: ``file`` (the path below ``path``, or below the folder before its
    first pattern) and the undecoded audio.

    Encode them before joining their transcripts: codes are a small part of the
    audio's size.
    """
    root = qualified(spark, path) + "/"
    full = F.col("path")
    unknown = F.raise_error(F.concat(F.lit(f"not below {root}: "), full)).cast("string")
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.when(F.startswith(full, F.lit(root)), F.substring(full, len(root) + 1, 1 << 30)).otherwise(unknown).alias("file"),
            F.struct(F.col("content").alias("bytes"), full.alias("path")).alias(into),
        )
    )


def read_merged_json(spark: SparkSession, path: str, *, array_file: bool = False) -> DataFrame:
    """A merged output: JSON Lines, or the older single-array file."""
    reader = spark.read.schema(ENCODED_SCHEMA)
    return reader.option("multiLine", "true").json(path) if array_file else reader.json(path)
