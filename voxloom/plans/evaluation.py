"""Generated audio scored against reference recordings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.audio import AudioLoader
from voxloom.operators.encode import Extractor, Generator, extract_features, generate_audio
from voxloom.operators.rows import attach_text, eval_speaker, skip_empty_text
from voxloom.operators.scoring import compare_pairs, eval_samples, eval_summary, pair_reference_generated
from voxloom.sources.readers import attach_sample_index, file_offsets, load_raw_audio, with_place
from voxloom.sources.writers import write_evaluation
from voxloom.specs import EvaluationRequest


def reference_samples(
    df: DataFrame,
    request: EvaluationRequest,
    load_extractor: Callable[[], Extractor],
    *,
    loader: AudioLoader = AudioLoader(),
    batch_rows: int = 1,
    key: Sequence[str] = ("sample_index",),
) -> DataFrame:
    """Features, text and speaker per reference sample, under its ``key``.

    Samples without text are skipped, unless their audio cannot be decoded: that
    is reported either way.  They get no features, so no other error can keep them.
    """
    named = eval_speaker(
        attach_text(df, text_column=request.text_column, into="_text"),
        speaker_column=request.speaker_column,
        speaker_id=request.speaker_id,
        into="_speaker",
    ).select(
        *key,
        F.col("_text").cast("string").alias("text"),
        F.col("_speaker").cast("string").alias("speaker"),
        F.col(request.audio_column).alias("audio"),
    )
    said = F.coalesce("text", F.lit("")) != ""
    featured = extract_features(named, load_extractor, loader=loader, batch_rows=batch_rows, wanted=said)
    return featured.where(F.col("error").isNotNull() | said)


def evaluate_pairs(
    reference: DataFrame,
    generated: DataFrame,
    request: EvaluationRequest,
    load_extractor: Callable[[], Extractor],
    *,
    loader: AudioLoader = AudioLoader(),
    audio: str = "audio",
    batch_rows: int = 1,
) -> DataFrame:
    """One result row per reference sample.

    Features are taken on each side before the join, so the join moves feature
    matrices and no audio.
    """
    return score_samples(
        reference_samples(reference, request, load_extractor, loader=loader, batch_rows=batch_rows),
        generated, load_extractor, loader=loader, audio=audio, batch_rows=batch_rows,
    )


def score_samples(
    ref: DataFrame,
    generated: DataFrame,
    load_extractor: Callable[[], Extractor],
    *,
    loader: AudioLoader = AudioLoader(),
    audio: str = "audio",
    batch_rows: int = 1,
) -> DataFrame:
    """One result row per featured reference sample."""
    kept = [c for c in ("error",) if c in generated.columns]
    gen = extract_features(
        generated.select("sample_index", F.col(audio).alias("audio"), *kept),
        load_extractor,
        loader=loader,
        batch_rows=batch_rows,
    )
    return eval_samples(compare_pairs(pair_reference_generated(ref, gen)))


def generated_samples(
    reference: DataFrame, request: EvaluationRequest, load_generator: Callable[[], Generator]
) -> DataFrame:
    """Audio generated for every reference sample that has text."""
    named = eval_speaker(
        attach_text(reference, text_column=request.text_column, into="_text"),
        speaker_column=request.speaker_column,
        speaker_id=request.speaker_id,
        into="_speaker",
    ).select(
        "sample_index",
        F.col("_text").cast("string").alias("text"),
        F.col("_speaker").cast("string").alias("speaker"),
    )
    return generate_audio(skip_empty_text(named), load_generator).drop("text", "speaker")


def run_evaluation(
    spark: SparkSession,
    request: EvaluationRequest,
    root: str,
    generated: DataFrame | Callable[[], Generator],
    load_extractor: Callable[[], Extractor],
    output: str,
    *,
    loader: AudioLoader = AudioLoader(),
    batch_rows: int = 1,
) -> DataFrame:
    """Score a dataset below ``root``, write rows and summary, return the summary.

    ``generated`` is a table of audio by ``sample_index``, or the loader of a
    model that generates it.

    Samples are numbered in stored order unless the dataset has a
    ``sample_index`` of its own.
    """
    reference = load_raw_audio(spark, root, request.dataset_name, split=request.split)
    if "sample_index" in reference.columns:
        numbered = reference
        ref = reference_samples(reference, request, load_extractor, loader=loader, batch_rows=batch_rows)
    else:  # numbers go to features and texts, never to audio
        offsets, placed = file_offsets(reference), with_place(reference)
        ref = attach_sample_index(
            reference_samples(
                placed, request, load_extractor, loader=loader, batch_rows=batch_rows, key=("_file", "_row")
            ),
            offsets,
        )
        numbered = attach_sample_index(placed.drop(request.audio_column), offsets)
    if not isinstance(generated, DataFrame):
        generated = generated_samples(numbered, request, generated)
    rows, _ = write_evaluation(
        score_samples(ref, generated, load_extractor, loader=loader, batch_rows=batch_rows), output
    )
    return eval_summary(spark.read.parquet(rows))
