"""Row filters, renames, unions, and speaker and text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANONYMOUS = "anon"  # fixed value


def categorical_filter(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose string column equals ``value``; nulls are dropped.

    Other types are refused, because Spark would coerce ``1 = '1'`` to true.
    """
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise TypeError(f"categorical filter needs a string column, {column!r} is not one")
    return df.where(F.col(column) == F.lit(value))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename source columns to their standard names, all at once, so names may swap."""
    missing = [old for old in names if old not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    moves = {old: new for old, new in names.items() if old != new}
    kept = set(df.columns) - set(moves)
    targets = list(moves.values())
    taken = [new for new in targets if new in kept or targets.count(new) > 1]
    if taken:
        raise ValueError(f"rename would duplicate columns: {sorted(set(taken))}")
    return df.select(*[F.col(f"`{c}`").alias(moves.get(c, c)) for c in df.columns])


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; a column that a source lacks becomes null."""
    if not frames:
        raise ValueError("at least one source is needed")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _fixed_or_column(df: DataFrame, column: str | None, fixed: str | None, default: Column) -> Column:
    if fixed is not None:
        return F.lit(fixed)
    if column and column in df.columns:
        return F.col(column)
    return default


def resolve_speaker(
    df: DataFrame, *, speaker_column: str | None = None, speaker_id: str | None = None, into: str = "speaker"
) -> DataFrame:
    """Fixed id, else the column if the source has it, else ``anon``.

    A null inside an existing column stays null.
    """
    return df.withColumn(into, _fixed_or_column(df, speaker_column, speaker_id, F.lit(ANONYMOUS)))


def eval_speaker(
    df: DataFrame, *, speaker_column: str | None = None, speaker_id: str | None = None, into: str = "speaker"
) -> DataFrame:
    """As ``resolve_speaker``, with null instead of ``anon``."""
    return df.withColumn(
        into, _fixed_or_column(df, speaker_column, speaker_id, F.lit(None).cast("string"))
    )


def attach_text(df: DataFrame, *, text_column: str, into: str = "text") -> DataFrame:
    """The text column, or empty strings when the source has none; nulls stay."""
    return df.withColumn(into, F.col(text_column) if text_column in df.columns else F.lit(""))


def skip_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.col(text).isNotNull() & (F.col(text) != ""))
