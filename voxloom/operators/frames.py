"""Duration filter, build errors, and codec frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import frames as fx
from voxloom.vocab import DEFAULT_LAYOUT, LAYERS, TokenLayout


def duration_filter(df: DataFrame, max_seconds: float | None, length: str = "encoded_len") -> DataFrame:
    """Rows that last at most ``max_seconds`` before frames are dropped."""
    return df.where(fx.within_duration(length, max_seconds)) if max_seconds else df


def filter_report(df: DataFrame, max_seconds: float | None, length: str = "encoded_len") -> DataFrame:
    """One row: how many rows the duration filter saw and how many it keeps."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(fx.within_duration(length, max_seconds)).alias("rows_after"),
    )


def build_errors(
    df: DataFrame,
    *,
    layers: Sequence[str] = LAYERS,
    length: str | None = "encoded_len",
    text: str = "text",
    into: str = "error",
) -> DataFrame:
    """Add the reason a row cannot be built, or null for a sound row.

    ``length=None`` leaves out the length, for builds without a duration limit.
    """
    reasons = [fx.layer_error(layers), F.when(F.col(text).isNull(), F.lit("null_text"))]
    if length is not None:
        reasons.insert(0, F.when(F.col(length).isNull(), F.lit("null_encoded_len")))
    return df.withColumn(into, F.coalesce(*reasons))


def require_sound(df: DataFrame, error: str = "error") -> DataFrame:
    """Fail the job at the first row that has an error."""
    verdict = F.when(F.col(error).isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unsound row: "), F.col(error))).cast("boolean")
    )
    return df.where(verdict).drop(error)


def add_frames(df: DataFrame, *, layers: Sequence[str] = LAYERS, dedup: bool = True, into: str = "frames") -> DataFrame:
    """Replace the layer columns by one array of frames, repeats dropped."""
    frames = fx.distinct_frames(layers) if dedup else fx.zip_frames(layers)
    return df.withColumn(into, frames).drop(*layers)


def add_codes(
    df: DataFrame,
    *,
    layers: Sequence[str] = LAYERS,
    layout: TokenLayout = DEFAULT_LAYOUT,
    frames: str = "frames",
) -> DataFrame:
    """Replace frames by ``codes_list`` and ``num_audio_frames``."""
    return (
        df.withColumn("codes_list", fx.interleave(frames, layers, layout))
        .withColumn("num_audio_frames", F.array_size(frames))
        .drop(frames)
    )


def drop_empty_codes(df: DataFrame, codes: str = "codes_list") -> DataFrame:
    """Rows whose code list is neither null nor empty.

    The list comes out of a one-element ``inline``, so that the condition is not pushed
    into the steps that make it: they would run twice.
    """
    made = df.select(*[c for c in df.columns if c != codes], F.inline(F.array(F.struct(codes))))
    return made.where(F.col(codes).isNotNull() & (F.array_size(codes) > 0)).select(*df.columns)
