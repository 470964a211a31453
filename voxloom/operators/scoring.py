"""Reference against generated audio: pairing, similarities, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import vectors as vx
from voxloom.functions.text import text_preview

NOT_GENERATED = "not_generated"
GENERATED_TWICE = "generated_twice"
FEATURES = ("mfcc", "chroma", "centroid")


def pair_reference_generated(
    reference: DataFrame, generated: DataFrame, *, on: str = "sample_index", suffix: str = "gen_", error: str = "error"
) -> DataFrame:
    """Left join on the sample; a reference without a partner gets an error.

    Columns of the generated side are prefixed with ``suffix``.  The first
    error wins: the reference's, the generated side's, then the missing partner.
    A sample that was generated more than once would come out more than once, so
    it gets one partner without values and the error ``generated_twice``.
    """
    values = [c for c in generated.columns if c != on]
    once = generated.groupBy(on).agg(
        F.count("*").alias("_times"), *[F.first(c).alias(c) for c in values]
    )
    single = F.col("_times") == 1
    right = once.select(
        on,
        *[F.when(single, F.col(c)).alias(suffix + c) for c in values if c != error],
        F.when(single, F.col(error) if error in values else F.lit(None)).otherwise(F.lit(GENERATED_TWICE)).alias(suffix + error),
        F.lit(True).alias("_found"),
    )
    joined = reference.join(right, on, "left")
    reasons = [F.col(c) for c in (error, suffix + error) if c in joined.columns]
    missing = F.when(F.col("_found").isNull(), F.lit(NOT_GENERATED))
    out = joined.withColumn(error, F.coalesce(*reasons, missing)).drop("_found")
    return out.drop(suffix + error) if suffix + error in out.columns else out


def mean_pool_long(df: DataFrame, *, by: Sequence[str], value: str = "value", into: str = "pooled") -> DataFrame:
    """Mean over frames of a long feature table; partial sums before the shuffle."""
    return df.groupBy(*by).agg(F.avg(value).alias(into))


def compare_pairs(df: DataFrame, *, gen: str = "gen_", error: str = "error") -> DataFrame:
    """Add the four similarities and the overall score, rounded.

    The overall score is taken from the unrounded parts.  Rows with an error
    keep null metrics.  A row whose features cannot be compared gets the reason as
    its error, and null metrics; the others do not notice.
    """
    def pooled_cosine(feature: str):
        return vx.cosine_similarity(vx.mean_pool(feature), vx.mean_pool(gen + feature))

    faults = [vx.matrix_fault(side + name) for name in FEATURES for side in ("", gen)]
    # Pooled vectors of different lengths are cut to the shorter; an alignment needs equal heights.
    reason = F.coalesce(F.col(error), *faults, vx.height_fault("mfcc", gen + "mfcc"))
    df = df.withColumn(error, reason)
    sound = F.col(error).isNull()
    scored = df.withColumns(
        {
            "mfcc_similarity": F.when(sound, pooled_cosine("mfcc")),
            "chroma_similarity": F.when(sound, pooled_cosine("chroma")),
            "spectral_centroid_similarity": F.when(sound, pooled_cosine("centroid")),
            "dtw_similarity": vx.dtw_similarity(
                F.when(sound, F.col("mfcc")), F.when(sound, F.col(gen + "mfcc"))
            ),
        }
    )
    return round_metrics(overall_score(scored))


def overall_score(df: DataFrame, into: str = "overall_score") -> DataFrame:
    return df.withColumn(into, vx.overall_score({name: F.col(name) for name in vx.WEIGHTS}))


def round_metrics(df: DataFrame, metrics: Sequence[str] = vx.METRICS) -> DataFrame:
    return df.withColumns({name: vx.round_metric(name) for name in metrics})


def eval_samples(df: DataFrame, *, text: str = "text", error: str = "error") -> DataFrame:
    """The per-row result: preview, metrics and error; failed rows have null metrics."""
    sound = F.col(error).isNull()
    return df.select(
        "sample_index",
        text_preview(text).alias("text"),
        *[F.when(sound, F.col(name)).alias(name) for name in vx.METRICS],
        F.col(error).alias("error"),
    )


def eval_summary(df: DataFrame) -> DataFrame:
    """One row: the means of the rounded metrics over scored rows, and both counts."""
    scored = F.col("overall_score").isNotNull()
    means = [
        F.coalesce(vx.round_metric(F.avg(F.when(scored, F.col(name)))), F.lit(0.0)).alias(name)
        for name in vx.METRICS
    ]
    return df.agg(
        *means,
        F.count_if(scored).alias("samples_evaluated"),
        F.count_if(~scored).alias("samples_failed"),
    )
