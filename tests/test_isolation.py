from __future__ import annotations

import ctypes
import os
import signal
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxloom.operators import encode
from voxloom.operators.isolation import TIMED_OUT, WORKER_LOST, Isolated, Isolation
from voxloom.plans import preparation
from voxloom.specs import PrepareRequest, RawSource

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load_runner():
    """Doubles numbers; negative ones crash it, zero hangs it, odd ones fail."""

    def run(values):
        made = []
        for v in values:
            if v == -1:
                ctypes.string_at(0)  # segmentation fault
            if v < 0:
                os._exit(3)
            if v == 0:
                time.sleep(60)
            made.append(ValueError(f"odd {v}") if v % 2 else 2 * v)
        return made

    return run


def shown(results):
    return [str(r) if isinstance(r, Exception) else r for r in results]


def test_a_row_that_costs_a_process_is_the_only_one_lost():
    model = Isolated(load_runner, Isolation(seconds=0.5))
    try:
        assert shown(model([2, 4])) == [4, 8]
        first = model.pid
        assert shown(model([2, -1, 6, 3, -2])) == [4, WORKER_LOST, 12, "odd 3", WORKER_LOST]
        assert model.pid != first
        started = time.time()
        assert shown(model([0, 8])) == [TIMED_OUT, 16]
        assert time.time() - started < 10
        assert shown(model([])) == []
    finally:
        model.close()
    model.close()  # twice does no harm
    with pytest.raises(ChildProcessError):
        os.waitpid(-1, os.WNOHANG)  # no child is left


def test_a_model_that_cannot_be_loaded_fails_the_call():
    def broken():
        raise OSError("no weights")

    def dying():
        os.kill(os.getpid(), signal.SIGKILL)

    for load, text in ((broken, "no weights"), (dying, "cannot be loaded"), (lambda: time.sleep(60), "cannot be loaded")):
        model = Isolated(load, Isolation(load_seconds=0.5))
        with pytest.raises(RuntimeError, match=text):
            model([1])
        assert model.pid is None


def load_encoder():
    def run(waves):
        for wave in waves:
            if len(wave) == 7:
                os.kill(os.getpid(), signal.SIGSEGV)
            if len(wave) == 11:
                time.sleep(60)
            if len(wave) == 5:
                raise RuntimeError("five")
        return [([[len(w)]] * 4, 1) for w in waves]

    return run


def waves(spark, sizes):
    rows = [(i, {"array": [0.5] * n, "sampling_rate": 22050}) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "id int, audio struct<array: array<float>, sampling_rate: int>")


@pytest.mark.parametrize("batch_rows", [2, 5])
def test_encoding_goes_on(spark, batch_rows):
    sizes = [n % 13 + 1 for n in range(60)]
    df = waves(spark, sizes).repartition(3)
    out = encode.encode_audio(df, load_encoder, batch_rows=batch_rows, isolation=Isolation(seconds=1.0))
    got = {r.id: (r.error, r.nano_layer_1) for r in out.collect()}
    reasons = {7: WORKER_LOST, 11: TIMED_OUT, 5: "five"}
    assert got == {i: (reasons[n], None) if n in reasons else (None, [n]) for i, n in enumerate(sizes)}


def test_a_whole_run_survives(spark, tmp_path):
    df = waves(spark, [3, 7, 4, 5, 6]).withColumn("text", F.concat(F.lit("t"), "id"))
    df.write.parquet(f"{tmp_path}/org/clips/train")
    request = PrepareRequest([RawSource("org/clips")], f"{tmp_path}/out", "org/merged")
    report = preparation.run_preparation(
        spark, request, str(tmp_path), load_encoder, batch_rows=3, isolation=Isolation(seconds=5.0)
    ).first()
    assert (report.total, report.processed, report.failed_samples) == (5, 3, 2)
    rejects = spark.read.parquet(*[str(p) for p in (tmp_path / "out" / "rejects").iterdir()])
    assert {(r.text, r.error) for r in rejects.collect()} == {("t1", WORKER_LOST), ("t3", "five")}
