from __future__ import annotations

import io
import struct
import sys
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import Observation
from pyspark.sql import functions as F

from voxloom.functions.audio import AudioError, AudioLoader, wav_decoder
from voxloom.operators import encode, report
from voxloom.plans import preparation
from voxloom.specs import RawSource
from voxloom.vocab import LAYERS, SAMPLE_RATE

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def wav(samples, rate=SAMPLE_RATE, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", s) for s in samples))
    return out.getvalue()


def load_encoder():
    def run(samples):
        if len(samples) == 0:
            raise RuntimeError("silence")
        codes = np.rint(samples * 32768).astype(int) % 4032
        return [codes, codes + 1, codes + 2, codes + 3], len(codes)

    return run


def rows(spark, *values):
    return spark.createDataFrame(
        [(i, {"bytes": v, "path": None} if v is not None else None) for i, v in enumerate(values)],
        "id int, audio struct<bytes:binary,path:string>",
    )


def test_wav_and_downmix():
    loader = AudioLoader()
    assert loader.load(wav([0, 16384])).tolist() == [0.0, 0.5]
    stereo = loader.load(wav([0, 16384, 8192, 8192], channels=2))
    assert stereo.tolist() == [0.25, 0.25]
    assert stereo.dtype == np.float32


def test_decoded_audio_is_not_downmixed():
    assert AudioLoader().load(array=[0.5, 1.0], rate=SAMPLE_RATE).tolist() == [0.5, 1.0]


def test_decoders_are_tried_in_order():
    def broken(data):
        raise OSError("not my format")

    assert AudioLoader(decoders=(broken, wav_decoder)).load(wav([16384])).tolist() == [0.5]
    with pytest.raises(OSError):
        AudioLoader(decoders=(wav_decoder, broken)).load(b"???")


def test_resampling():
    with pytest.raises(AudioError, match="no_resampler"):
        AudioLoader().load(wav([1, 2], rate=8000))
    loader = AudioLoader(resampler=lambda x, a, b: np.repeat(x, b // a))
    assert len(loader.load(wav([1, 2], rate=11025))) == 4


def test_rows_fail_alone(spark):
    out = encode.encode_audio(rows(spark, wav([1, 2, 3]), b"junk", None, wav([])), load_encoder)
    got = {r.id: r for r in out.collect()}
    assert got[0].nano_layer_1 == [1, 2, 3] and got[0].nano_layer_4 == [4, 5, 6]
    assert got[0].encoded_len == 3 and got[0].error is None
    assert got[2].error == "unsupported_audio"
    assert got[3].error == "silence"
    assert all(got[i].error and got[i].nano_layer_1 is None and got[i].encoded_len is None for i in (1, 2, 3))


def test_wrong_layer_count_is_a_row_error(spark):
    out = encode.encode_audio(rows(spark, wav([1])), lambda: lambda x: ([[1], [2]], 1)).first()
    assert out.error and out.nano_layer_1 is None


def test_encoder_is_loaded_once_per_task(spark):
    def load():
        calls = []

        def run(samples):
            calls.append(1)
            return [[len(calls)]] * 4, 1

        return run

    out = encode.encode_audio(rows(spark, *[wav([1])] * 20).coalesce(1), load)
    assert sorted(r.nano_layer_1[0] for r in out.collect()) == list(range(1, 21))


def test_batches_are_cut_by_bytes(spark):
    """Fat rows must not pile up in one Arrow batch."""
    big = spark.range(0, 60, 1, 1).select(
        F.col("id").cast("int").alias("id"),
        F.struct(F.encode(F.repeat(F.lit("x"), 4_000_000), "UTF-8").alias("bytes")).alias("audio"),
    )

    def sizes(batches):
        for b in batches:
            yield b[["id"]].assign(n=len(b))

    parts = big.select("id", "audio.bytes").mapInPandas(sizes, "id int, n int")
    assert parts.agg(F.max("n")).first()[0] < 60


def test_counters_add_up(spark):
    prepared = preparation.prepare_sources(
        [
            (rows(spark, wav([1]), b"junk").withColumn("text", F.lit("a")), RawSource("x/one", speaker_id="ann")),
            (rows(spark, wav([2]), wav([3])), RawSource("x/two", text_column="sentence")),
        ],
        load_encoder,
        key="id",
    )
    sound, rejects = report.split_rejects(prepared)
    assert {(r.source, r.text, r.speaker) for r in sound.collect()} == {("x/one", "a", "ann"), ("x/two", "", "anon")}
    assert [r.row_key for r in rejects.collect()] == ["1"]
    counts = {r.source: (r.total, r.processed, r.failed_samples) for r in report.prep_counters(prepared).collect()}
    assert counts == {"x/one": (2, 1, 1), "x/two": (2, 2, 0), None: (4, 3, 1)}
    row = report.run_report(prepared, datasets_total=2).first()
    assert (row.status, row.total, row.processed, row.failed_samples) == ("completed", 4, 3, 1)
    counters = Observation("t")
    report.observed(prepared, counters).collect()
    assert counters.get == {"total": 4, "processed": 3, "failed_samples": 1}


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "source string, error string")
    row = report.run_report(empty, datasets_total=1).first()
    assert (row.total, row.processed, row.failed_samples) == (0, 0, 0)


def test_features(spark):
    def load():
        return lambda x: {"mfcc": np.tile(x, (2, 1)), "chroma": x[None, :], "centroid": x}

    out = encode.extract_features(rows(spark, wav([16384, 0]), None), load).orderBy("id").collect()
    assert out[0].mfcc == [[0.5, 0.0], [0.5, 0.0]] and out[0].centroid == [[0.5, 0.0]]
    assert out[1].mfcc is None and out[1].error == "unsupported_audio"


def test_layers_feed_the_build(spark):
    from voxloom.plans.training import build_rows, sound_rows

    prepared = preparation.prepare_source(
        rows(spark, wav([5, 5, 7])).withColumn("text", F.lit("hi")), RawSource("x/y", speaker_id="Ann"), load_encoder, key="id"
    )
    sound, _ = report.split_rejects(prepared)
    built = build_rows(sound_rows(sound.select("row_key", *LAYERS, "encoded_len", "text", "speaker"), max_seconds=30)).first()
    assert built.input_ids[-10:] == [64415, 68448, 72481, 76514, 64417, 68450, 72483, 76516, 64402, 64406]


def test_codec_decoding(spark):
    from voxloom.plans.decoding import decode_waveforms

    ids = [1, 5, 2, 64401, 64415, 68443, 72476, 76509, 64402]
    df = spark.createDataFrame([(0, ids), (1, ids[:-1]), (2, ids)], "id int, ids array<int>")

    def load_decoder():
        return lambda codes: codes.sum(axis=0) / 100.0

    out = {r.id: r for r in decode_waveforms(df, load_decoder).collect()}
    assert out[0].audio.sampling_rate == SAMPLE_RATE
    assert out[0].audio.array == pytest.approx([0.11])
    assert out[0].error is None
    assert out[1].error == "missing_marker" and out[1].audio is None


def test_models_run_once_per_row_under_filters(spark):
    """A filter on the result must not make the model run again."""
    calls = spark.sparkContext.accumulator(0)

    def load():
        def run(samples):
            calls.add(1)
            return [[1]] * 4, 1

        return run

    out = encode.encode_audio(rows(spark, *[wav([1])] * 6), load).where("error IS NULL AND encoded_len = 1")
    assert len(out.select("id", "nano_layer_1").collect()) == 6
    assert calls.value == 6


def test_installed_helpers_always_read_wav():
    from voxloom.functions.audio import installed_decoders, installed_resampler

    decoders = installed_decoders()
    assert decoders[-1] is wav_decoder
    loader = AudioLoader(tuple(decoders), installed_resampler())
    assert loader.load(wav([0, 16384])).tolist() == [0.0, 0.5]


def test_lists_of_waveforms(spark):
    """A model may get lists; one that fails is tried again row by row."""

    def load():
        def run(waves):
            assert 1 <= len(waves) <= 3
            if len(waves) > 1 and any(len(w) == 2 for w in waves):
                raise RuntimeError("mixed")
            if len(waves[0]) == 2:
                raise RuntimeError("two")
            return [([[len(w)]] * 4, 1) for w in waves]

        return run

    df = rows(spark, *[wav([1] * n) for n in (1, 3, 2, 4, 5, 6, 7)], b"junk").coalesce(1)
    got = {r.id: (r.nano_layer_1, r.error) for r in encode.encode_audio(df, load, batch_rows=3).collect()}
    assert [got[i][0] for i in range(7)] == [[1], [3], None, [4], [5], [6], [7]]
    assert got[2][1] == "two" and got[7][0] is None and got[7][1]


def test_output_leaves_by_bytes(spark, monkeypatch):
    """Small inputs may make large outputs: no batch that a worker returns exceeds the limit by more than a row."""
    from pyspark.sql import types as T

    def load():
        return (lambda n: n), (lambda values: [{"x": [1] * 25_000} for _ in values])

    made_of = []
    monkeypatch.setattr(encode.F, "arrow_udf", lambda returned: lambda f: made_of.append(f) or F.udf(lambda *x: None, returned))
    produced = [T.StructField("x", T.ArrayType(T.IntegerType()))]
    encode._row_job(
        spark.range(1), inputs=[F.col("id")], consumed=[], load=load, produced=produced, error="error", output_bytes=1_000_000
    )
    batch = (pa.array([None] * 200, pa.string()), pa.array(range(200)))
    out = list(made_of[0](iter([batch])))
    assert sum(len(b) for b in out) == 200
    assert len(out) > 10 and max(b.nbytes for b in out) < 1_000_000 + 110_000


def test_rows_that_are_not_wanted_are_only_decoded(spark):
    def load():
        def run(wave):
            raise RuntimeError("must not run")

        return run

    df = rows(spark, wav([1]), b"junk")
    got = {r.id: r.error for r in encode.extract_features(df, load, wanted=F.lit(False)).collect()}
    assert got[0] is None and got[1] is not None and "must not run" not in got[1]
