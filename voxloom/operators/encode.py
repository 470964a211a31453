"""Arrow jobs that call a model: codec encoding and decoding, feature extraction,
and speech generation.

A failing row never fails the job: it comes out with nulls and an ``error``.
The callables are loaded once per task.  A model gets one value at a time, or, with
``batch_rows`` above 1, lists of at most that many values and ``BATCH_BYTES`` bytes;
a list that fails is tried again value by value.  Output leaves the worker as soon
as it reaches ``OUTPUT_BYTES``, however small the rows were that it was made from.
With ``isolation`` the calls are made in a child process: a row on which the model
dies or hangs gets ``worker_lost`` or ``timed_out`` as its error, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxloom.functions.audio import AudioLoader
from voxloom.operators.isolation import Isolated, Isolation, Run
from voxloom.vocab import LAYERS, SAMPLE_RATE

# waveform -> (one code sequence per layer, number of frames)
Encoder = Callable[[np.ndarray], tuple[Sequence[Sequence[int]], int]]
# (layers, frames) codes -> waveform
CodecDecoder = Callable[[np.ndarray], np.ndarray]
# waveform -> feature name -> (features, frames) matrix
Extractor = Callable[[np.ndarray], Mapping[str, np.ndarray]]
# The same for lists, with one result per element.
BatchEncoder = Callable[[list[np.ndarray]], Sequence[tuple[Sequence[Sequence[int]], int]]]
BatchExtractor = Callable[[list[np.ndarray]], Sequence[Mapping[str, np.ndarray]]]
# (text, speaker or None) -> waveform
Generator = Callable[[str, str | None], np.ndarray]

FEATURES = ("mfcc", "chroma", "centroid")

# Bytes of prepared values that a model gets at once, and of results that a worker holds.
BATCH_BYTES = 64_000_000
OUTPUT_BYTES = 8_000_000

_INTS = T.ArrayType(T.IntegerType())
_MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))


def _audio_parts(df: DataFrame, audio: str) -> list[Column]:
    """Bytes, samples and rate of an audio struct; fields it lacks are null."""
    present = set(df.schema[audio].dataType.fieldNames())

    def part(name: str, as_type: str) -> Column:
        value = F.col(audio)[name] if name in present else F.lit(None)
        return value.cast(as_type)

    return [part("bytes", "binary"), part("array", "array<float>"), part("sampling_rate", "int")]


# Prepares one row's inputs; turns a list of prepared values into as many rows of produced values.
Job = tuple[Callable[..., Any], Callable[[list[Any]], Sequence[Mapping[str, Any]]]]


def _value(scalar: pa.Scalar) -> Any:
    """A list as a numpy array, anything else as its Python value."""
    if not scalar.is_valid:
        return None
    return scalar.values.to_numpy(zero_copy_only=False) if isinstance(scalar, pa.ListScalar) else scalar.as_py()


def _size(value: Any) -> int:
    return getattr(value, "nbytes", None) or (len(value) if hasattr(value, "__len__") else 8)


def _cut_lists(prepared: Sequence[Any], batch_rows: int, batch_bytes: int) -> Iterator[list[int]]:
    """Positions of prepared values, as lists that a model may get; failed ones are left out."""
    chosen: list[int] = []
    held = 0
    for i, value in enumerate(prepared):
        if isinstance(value, Exception):
            continue
        size = _size(value)
        if chosen and (len(chosen) >= batch_rows or held + size > batch_bytes):
            yield chosen
            chosen, held = [], 0
        chosen.append(i)
        held += size
    if chosen:
        yield chosen


def _isolated(call: Callable[[list[Any]], Sequence[Any]], values: list[Any]) -> list[Any]:
    """Results of a list; of one that fails, value by value, with the exception in a failed one's place."""
    try:
        found = list(call(values))
        if len(found) != len(values):
            raise ValueError(f"{len(found)} results for {len(values)} values")
        return found
    except Exception as exc:
        if len(values) == 1:
            return [exc]
        return [_isolated(call, [v])[0] for v in values]


def _window_runner(load: Callable[[], Job], batch_rows: int, batch_bytes: int) -> Callable[[], Run]:
    """Loads a function from rows of input values to rows of produced values, an exception in a failed one's place."""

    def loaded() -> Run:
        prepare, work = load()

        def run(rows: list[list[Any]]) -> list[Any]:
            prepared: list[Any] = []
            for values in rows:
                try:
                    prepared.append(prepare(*values))
                except Exception as exc:  # isolate the row
                    prepared.append(exc)
            made = list(prepared)
            for chosen in _cut_lists(prepared, batch_rows, batch_bytes):
                for i, result in zip(chosen, _isolated(work, [prepared[i] for i in chosen])):
                    made[i] = result
            return made

        return run

    return loaded


def _row_job(
    df: DataFrame,
    *,
    inputs: Sequence[Column],
    consumed: Sequence[str],
    load: Callable[[], Job],
    produced: Sequence[T.StructField],
    error: str,
    batch_rows: int = 1,
    batch_bytes: int = BATCH_BYTES,
    output_bytes: int = OUTPUT_BYTES,
    isolation: Isolation | None = None,
) -> DataFrame:
    """Run a job on the ``inputs`` of every row, keeping other columns.

    A row that already has an error is passed on with nulls.  Only the inputs go to
    Python; all other columns stay in the JVM.
    """
    returned = T.StructType([*produced, T.StructField(error, T.StringType())])
    kind = to_arrow_type(returned)
    window = max(1, batch_rows)
    loaded = _window_runner(load, batch_rows, batch_bytes)

    @F.arrow_udf(returned)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        model = loaded() if isolation is None else Isolated(loaded, isolation)

        def failed(reason: Any) -> pa.Array:
            text = reason if isinstance(reason, str) else str(reason) or type(reason).__name__
            return pa.array([{error: text}], kind)

        try:
            for before, *columns in batches:
                pieces: list[pa.Array] = []
                held = 0
                for start in range(0, len(before), window):
                    places = range(start, min(start + window, len(before)))
                    rows: list[Any] = [before[i].as_py() for i in places]  # earlier reasons
                    wanted = [k for k, reason in enumerate(rows) if reason is None]
                    values = [[_value(c[start + k]) for c in columns] for k in wanted]
                    for k, made in zip(wanted, model(values) if values else ()):
                        rows[k] = made
                    for row in rows:
                        if isinstance(row, (str, Exception)):
                            piece = failed(row)
                        else:
                            try:
                                piece = pa.array([dict(row)], kind)
                            except Exception as exc:  # not what the columns hold
                                piece = failed(exc)
                        pieces.append(piece)
                        held += piece.nbytes
                        if held >= output_bytes:
                            yield pa.concat_arrays(pieces)
                            pieces, held = [], 0
                if pieces:
                    yield pa.concat_arrays(pieces)
        finally:
            if isolation is not None:
                model.close()

    earlier = F.col(error) if error in df.columns else F.lit(None).cast("string")
    # Not deterministic to the optimizer, so that no filter on the result makes it run the model twice.
    made = run.asNondeterministic()(earlier, *inputs)
    kept = [c for c in df.columns if c not in {*consumed, error}]
    return df.withColumn("_made", made).select(*kept, "_made.*")


def _each(one: Callable[[Any], Any]) -> Callable[[list[Any]], list[Any]]:
    return lambda values: [one(v) for v in values]


def _audio_job(
    df: DataFrame,
    *,
    audio: str,
    loader: AudioLoader,
    load: Callable[[], Callable[[list[np.ndarray]], Sequence[Mapping[str, Any]]]],
    produced: Sequence[T.StructField],
    error: str,
    batch_rows: int,
    wanted: Column | None = None,
    isolation: Isolation | None = None,
) -> DataFrame:
    """Run a model over an audio column; rows that are not ``wanted`` are only decoded."""

    def load_job() -> Job:
        work = load()

        def prepare(data: bytes | None, array: Any, rate: Any, use: bool | None) -> np.ndarray | None:
            wave = loader.load(data, array, None if rate is None else int(rate))
            return wave if use else None

        def call(waves: list[np.ndarray | None]) -> list[Mapping[str, Any]]:
            found = iter(work([w for w in waves if w is not None]))
            return [{} if w is None else next(found) for w in waves]

        return prepare, call

    chosen = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    return _row_job(
        df,
        inputs=[*_audio_parts(df, audio), chosen],
        consumed=[audio],
        load=load_job,
        produced=produced,
        error=error,
        batch_rows=batch_rows,
        isolation=isolation,
    )


def encode_audio(
    df: DataFrame,
    load_encoder: Callable[[], Encoder] | Callable[[], BatchEncoder],
    *,
    audio: str = "audio",
    loader: AudioLoader = AudioLoader(),
    batch_rows: int = 1,
    isolation: Isolation | None = None,
    error: str = "error",
) -> DataFrame:
    """Replace the audio column by four code layers, ``encoded_len`` and ``error``.

    With ``batch_rows`` above 1 the encoder gets lists of waveforms.
    """

    def load() -> Callable[[list[np.ndarray]], list[dict[str, Any]]]:
        encoder = load_encoder()
        many = encoder if batch_rows > 1 else _each(encoder)

        def row(made: tuple[Sequence[Sequence[int]], int]) -> dict[str, Any]:
            layers, length = made
            codes = {name: np.asarray(layer, dtype=np.int32) for name, layer in zip(LAYERS, layers, strict=True)}
            return codes | {"encoded_len": int(length)}

        return lambda waves: [row(made) for made in many(waves)] if waves else []

    produced = [T.StructField(n, _INTS) for n in LAYERS]
    produced.append(T.StructField("encoded_len", T.IntegerType()))
    return _audio_job(
        df,
        audio=audio,
        loader=loader,
        load=load,
        produced=produced,
        error=error,
        batch_rows=batch_rows,
        isolation=isolation,
    )


def extract_features(
    df: DataFrame,
    load_extractor: Callable[[], Extractor] | Callable[[], BatchExtractor],
    *,
    audio: str = "audio",
    loader: AudioLoader = AudioLoader(),
    features: Sequence[str] = FEATURES,
    batch_rows: int = 1,
    wanted: Column | None = None,
    isolation: Isolation | None = None,
    error: str = "error",
) -> DataFrame:
    """Replace the audio column by feature matrices (features by frames) and ``error``.

    One row per sample: matrices are a small part of the waveform's size, so
    later joins move features, never audio.  Rows that are not ``wanted`` are
    decoded, so that a decoding error shows, but get no features.
    """

    def load() -> Callable[[list[np.ndarray]], list[dict[str, Any]]]:
        extractor = load_extractor()
        many = extractor if batch_rows > 1 else _each(extractor)

        def row(found: Mapping[str, np.ndarray]) -> dict[str, Any]:
            return {n: [np.asarray(r, dtype=np.float64) for r in np.atleast_2d(found[n])] for n in features}

        return lambda waves: [row(found) for found in many(waves)] if waves else []

    produced = [T.StructField(n, _MATRIX) for n in features]
    return _audio_job(
        df,
        audio=audio,
        loader=loader,
        load=load,
        produced=produced,
        error=error,
        batch_rows=batch_rows,
        wanted=wanted,
        isolation=isolation,
    )


def _produced_audio(audio: str) -> T.StructField:
    value = T.StructType(
        [T.StructField("array", T.ArrayType(T.FloatType())), T.StructField("sampling_rate", T.IntegerType())]
    )
    return T.StructField(audio, value)


def _audio_value(wave: np.ndarray) -> dict[str, Any]:
    return {"array": np.asarray(wave, dtype=np.float32).ravel(), "sampling_rate": SAMPLE_RATE}


def decode_audio(
    df: DataFrame,
    load_decoder: Callable[[], CodecDecoder],
    *,
    layers: Sequence[str] = LAYERS,
    audio: str = "audio",
    batch_rows: int = 1,
    isolation: Isolation | None = None,
    error: str = "error",
) -> DataFrame:
    """Replace the code layers by decoded audio at the codec's rate, and ``error``.

    With ``batch_rows`` above 1 the decoder gets lists of code arrays.
    """

    def load() -> Job:
        decoder = load_decoder()
        many = decoder if batch_rows > 1 else _each(decoder)

        def prepare(*codes: np.ndarray) -> np.ndarray:
            return np.stack([np.asarray(c, dtype=np.int64) for c in codes])

        return prepare, lambda values: [{audio: _audio_value(wave)} for wave in many(values)]

    return _row_job(
        df,
        inputs=[F.col(n) for n in layers],
        consumed=layers,
        load=load,
        produced=[_produced_audio(audio)],
        error=error,
        batch_rows=batch_rows,
        isolation=isolation,
    )


def generate_audio(
    df: DataFrame,
    load_generator: Callable[[], Generator],
    *,
    text: str = "text",
    speaker: str = "speaker",
    audio: str = "audio",
    isolation: Isolation | None = None,
    error: str = "error",
) -> DataFrame:
    """Add generated speech for each row's text and speaker, and ``error``."""

    def load() -> Job:
        generate = load_generator()
        return lambda *values: values, _each(lambda values: {audio: _audio_value(generate(*values))})

    return _row_job(
        df,
        inputs=[F.col(text), F.col(speaker)],
        consumed=[],
        load=load,
        produced=[_produced_audio(audio)],
        error=error,
        isolation=isolation,
    )


def long_features(df: DataFrame, *, sample: str, features: Sequence[str] = FEATURES) -> DataFrame:
    """Feature matrices as ``(sample, feature, coeff, frame, value)`` rows."""
    named = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("matrix")) for n in features])
    return (
        df.select(sample, F.inline(named))
        .select(sample, "feature", F.posexplode("matrix").alias("coeff", "row"))
        .select(sample, "feature", "coeff", F.posexplode("row").alias("frame", "value"))
    )


def librosa_extractor() -> Extractor:
    """MFCC (13), chroma and spectral centroid, if that library is installed."""
    import librosa

    def extract(wave: np.ndarray) -> dict[str, np.ndarray]:
        return {
            "mfcc": librosa.feature.mfcc(y=wave, sr=SAMPLE_RATE, n_mfcc=13),
            "chroma": librosa.feature.chroma_stft(y=wave, sr=SAMPLE_RATE),
            "centroid": librosa.feature.spectral_centroid(y=wave, sr=SAMPLE_RATE),
        }

    return extract
