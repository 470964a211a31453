"""Raw audio sources to one merged, encoded dataset."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.audio import AudioLoader
from voxloom.operators.encode import BatchEncoder, Encoder, encode_audio
from voxloom.operators.isolation import Isolation
from voxloom.operators.report import observed, prep_counters, run_report, split_rejects
from voxloom.operators.rows import attach_text, resolve_speaker, union_sources
from voxloom.session import COMPACT_ROWS, folder_names, remove_table, scratch_path
from voxloom.sources.readers import dataset_path, load_raw_audio
from voxloom.sources.writers import publish_encoded, write_merged_json
from voxloom.specs import PrepareRequest, RawSource, merged_name
from voxloom.streaming.state import MicroState, run_available
from voxloom.streaming.status import RunStatus


def prepare_source(
    df: DataFrame,
    source: RawSource,
    load_encoder: Callable[[], Encoder] | Callable[[], BatchEncoder],
    *,
    loader: AudioLoader = AudioLoader(),
    key: str | None = None,
    batch_rows: int = 1,
    isolation: Isolation | None = None,
) -> DataFrame:
    """Encoded rows of one source, failed ones included with their error.

    With ``batch_rows`` above 1 the encoder gets lists of waveforms; with
    ``isolation`` it runs in a process of its own.
    """
    named = resolve_speaker(
        attach_text(df, text_column=source.text_column, into="_text"),
        speaker_column=source.speaker_column,
        speaker_id=source.speaker_id,
        into="_speaker",
    ).select(
        F.lit(source.dataset_name).alias("source"),
        *([F.col(key).cast("string").alias("row_key")] if key else []),
        F.col("_text").cast("string").alias("text"),
        F.col("_speaker").cast("string").alias("speaker"),
        F.col(source.audio_column).alias("audio"),
    )
    return encode_audio(named, load_encoder, loader=loader, batch_rows=batch_rows, isolation=isolation)


def prepare_sources(
    sources: Sequence[tuple[DataFrame, RawSource]],
    load_encoder: Callable[[], Encoder] | Callable[[], BatchEncoder],
    *,
    loader: AudioLoader = AudioLoader(),
    key: str | None = None,
    batch_rows: int = 1,
    isolation: Isolation | None = None,
) -> DataFrame:
    """Encoded rows of all sources, with ``source`` and ``error``."""
    how = {"loader": loader, "key": key, "batch_rows": batch_rows, "isolation": isolation}
    return union_sources([prepare_source(df, spec, load_encoder, **how) for df, spec in sources])


def prepare_audio_files(
    files: DataFrame,
    transcripts: DataFrame,
    source: RawSource,
    load_encoder: Callable[[], Encoder] | Callable[[], BatchEncoder],
    *,
    loader: AudioLoader = AudioLoader(),
    on: str = "file",
    batch_rows: int = 1,
    isolation: Isolation | None = None,
) -> DataFrame:
    """Encoded rows of a transcript table whose audio lies in files.

    The files are encoded first, so the join moves codes instead of audio.  A
    transcript without its file is a failed row.
    """
    codes = encode_audio(
        files.select(on, F.col(source.audio_column).alias("audio")),
        load_encoder,
        loader=loader,
        batch_rows=batch_rows,
        isolation=isolation,
    ).withColumn("_found", F.lit(True))
    named = resolve_speaker(
        attach_text(transcripts, text_column=source.text_column, into="_text"),
        speaker_column=source.speaker_column,
        speaker_id=source.speaker_id,
        into="_speaker",
    ).select(
        F.lit(source.dataset_name).alias("source"),
        F.col(on),
        F.col("_text").cast("string").alias("text"),
        F.col("_speaker").cast("string").alias("speaker"),
    )
    missing = F.when(F.col("_found").isNull(), F.lit("missing_audio"))
    return (
        named.join(codes, on, "left")
        .withColumn("error", F.coalesce("error", missing))
        .withColumnRenamed(on, "row_key")
        .drop("_found")
    )


def run_preparation(
    spark: SparkSession,
    request: PrepareRequest,
    root: str,
    load_encoder: Callable[[], Encoder] | Callable[[], BatchEncoder],
    *,
    loader: AudioLoader = AudioLoader(),
    progress: Observation | None = None,
    staging: str | None = None,
    batch_rows: int = 1,
    isolation: Isolation | None = None,
) -> DataFrame:
    """Encode and merge the sources below ``root``; returns the one-row run report.

    The codec runs once per row: its output is staged as a table in the shared
    folder, and the merged JSON, the published dataset, the rejects and the
    report all read that table.  It is removed once all of them are written, unless
    ``staging`` names its place.  ``progress`` is filled with the run's counters
    as soon as the models are done.  With ``batch_rows`` above 1 the encoder gets
    lists of waveforms; with ``isolation`` a waveform on which it dies or hangs is
    a failed row, and the run goes on.
    """
    sources = [
        (load_raw_audio(spark, root, s.dataset_name, split=s.split), s) for s in request.datasets
    ]
    encoded = prepare_sources(sources, load_encoder, loader=loader, batch_rows=batch_rows, isolation=isolation)
    if progress is not None:
        encoded = observed(encoded, progress)
    stage = staging or scratch_path(spark, "prepare")
    encoded.write.mode("overwrite").options(**COMPACT_ROWS).parquet(stage)

    report = _write_prepared(spark, spark.read.parquet(stage), request)
    if staging is None:
        remove_table(spark, stage)
    return report


def _write_prepared(spark: SparkSession, staged: DataFrame, request: PrepareRequest) -> DataFrame:
    """Merged JSON, published dataset, rejects and counters of stored rows; returns the one-row report."""
    sound, rejects = split_rejects(staged)
    names = [s.dataset_name for s in request.datasets]
    path = write_merged_json(sound, request.output_dir, names, request.hub_repo)
    rejects.select("source", "text", "speaker", "error").write.mode("overwrite").parquet(
        f"{request.output_dir.rstrip('/')}/rejects/{merged_name(names, request.hub_repo)}"
    )
    if request.hub_repo:
        publish_encoded(sound.drop("source"), request.output_dir, request.hub_repo)
    # Counters per source, with a total, beside the rejects.
    folder, name = request.output_dir.rstrip("/"), merged_name(names, request.hub_repo)
    prep_counters(staged).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counters/{name}")
    done = run_report(staged, datasets_total=len(names), output_path=path, hub_repo=request.hub_repo)
    return spark.createDataFrame(done.collect(), done.schema)  # one row


def prepare_live(
    spark: SparkSession,
    request: PrepareRequest,
    root: str,
    load_encoder: Callable[[], Encoder] | Callable[[], BatchEncoder],
    place: str,
    *,
    files_per_step: int = 1000,
    loader: AudioLoader = AudioLoader(),
    batch_rows: int = 1,
    isolation: Isolation | None = None,
) -> DataFrame:
    """``run_preparation`` that tells how far it is and goes on where it was ended.

    The sources are read one after the other as streams, ``files_per_step`` files at
    a time.  Each step's rows are stored below ``place``, a shared folder, and its
    counts added to the ``RunStatus`` in ``place/status``: ``starting``, ``running``
    after every step, then ``completed``, or ``failed`` with the error, which is raised.
    Called again with the same ``place`` the run repeats no step that was stored.
    """
    place = place.rstrip("/")
    status = RunStatus(spark, f"{place}/status")
    known = {"datasets_total": len(request.datasets), "hub_repo": request.hub_repo}
    counts = {"total": 0, "processed": 0, "failed_samples": 0}
    done, current = 0, None
    status.note("starting", datasets_done=0, **counts, **known)
    try:
        for done, source in enumerate(request.datasets):
            current = source.dataset_name
            before = dict(counts)
            state = MicroState(f"{place}/state/{done}")

            def tell(micro: int | None) -> None:
                mark = None if micro is None else state.mark(spark, micro).asDict()
                counts.update({c: before[c] + (mark[c] if mark else 0) for c in counts})
                status.note("running", current_dataset=current, datasets_done=done, **counts, **known)

            def step(rows: DataFrame, micro: int) -> None:
                due, last = state.due(spark, micro)
                if due:
                    path = f"{place}/encoded/{done}/step={micro}"
                    encoded = prepare_source(rows, source, load_encoder, loader=loader, batch_rows=batch_rows, isolation=isolation)
                    encoded.write.mode("overwrite").options(**COMPACT_ROWS).parquet(path)
                    failed = F.count_if(F.col("error").isNotNull())
                    n, bad = spark.read.schema(encoded.schema).parquet(path).agg(F.count(F.lit(1)), failed).first()
                    old = {"total": 0, "processed": 0, "failed_samples": 0} if last is None else state.mark(spark, last).asDict()
                    state.finish(
                        spark, micro, total=old["total"] + n, processed=old["processed"] + n - bad, failed_samples=old["failed_samples"] + bad
                    )
                tell(micro)

            stored = load_raw_audio(spark, root, current, split=source.split)
            stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files_per_step)
            stream = stream.parquet(dataset_path(root, current, None, source.split))
            tell(state.committed(spark))
            run_available(stream, step, f"{place}/checkpoint/{done}").awaitTermination()
            tell(state.committed(spark))
        done, current = len(request.datasets), None
        schema = prepare_source(stored, source, load_encoder, loader=loader, batch_rows=batch_rows, isolation=isolation).schema
        steps = [
            f"{place}/encoded/{k}/{name}"
            for k in range(done)
            for name in folder_names(spark, f"{place}/encoded/{k}")
            if name.startswith("step=")
        ]
        rows = spark.read.schema(schema).parquet(*steps) if steps else spark.createDataFrame([], schema)
        report = _write_prepared(spark, rows, request)
    except Exception as failure:
        status.note("failed", current_dataset=current, datasets_done=done, error=str(failure), **counts, **known)
        raise
    status.note("completed", datasets_done=done, output_path=report.first().output_path, **counts, **known)
    return report
