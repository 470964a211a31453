from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxloom.functions import frames as fx
from voxloom.functions.text import speaker_prompt
from voxloom.operators import frames, rows
from voxloom.plans import training

SCHEMA = (
    "row_key string, nano_layer_1 array<int>, nano_layer_2 array<int>, nano_layer_3 array<int>, "
    "nano_layer_4 array<int>, encoded_len int, text string, speaker string"
)


def layered(spark, *cases):
    return spark.createDataFrame(cases, SCHEMA)


def sound(key="ok", n=2, text="t", length=2):
    return (key, *[list(range(n))] * 4, length, text, None)


def test_filter_drops_nulls_and_refuses_numbers(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("b", 1)], "s string, i int")
    assert rows.categorical_filter(df, "s", "a").count() == 1
    with pytest.raises(TypeError):
        rows.categorical_filter(df, "i", "1")


def test_rename_checks(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rows.rename_columns(df, {"a": "x", "b": "b"}).columns == ["x", "b"]
    assert rows.rename_columns(df, {"a": "b", "b": "a"}).columns == ["b", "a"]
    with pytest.raises(ValueError):
        rows.rename_columns(df, {"a": "b"})
    with pytest.raises(ValueError):
        rows.rename_columns(df, {"missing": "x"})


def test_speaker_null_stays_null(spark):
    df = spark.createDataFrame([("s",), (None,)], "who string")
    found = [r.speaker for r in rows.resolve_speaker(df, speaker_column="who").collect()]
    assert found == ["s", None]
    assert rows.resolve_speaker(df, speaker_column="nope").first().speaker == "anon"
    assert rows.eval_speaker(df, speaker_column="nope").first().speaker is None


def test_prompt_rules(spark):
    df = spark.createDataFrame([("T", "Ann"), ("T", ""), ("T", None)], "text string, speaker string")
    shown = [r[0] for r in df.select(speaker_prompt("text", F.col("speaker"))).collect()]
    assert shown == ["ann: T", ": T", "T"]
    assert df.select(speaker_prompt("text", F.col("speaker"), "Robin")).first()[0] == "robin: T"


@pytest.mark.parametrize("limit", [0, 1, 2, 7, 30, 0.5, 29.99])
def test_integer_duration_equals_division(spark, limit):
    df = spark.range(0, 500).withColumn("n", F.col("id").cast("int"))
    kept = {r.n for r in frames.duration_filter(df, limit, "n").collect()}
    assert kept == {n for n in range(500) if not limit or n / 12.5 <= limit}
    assert frames.filter_report(df, limit, "n").first().rows_after == len(kept)


def test_max_frames():
    assert fx.max_frames(30) == 375


def test_build_error_kinds(spark):
    full = [0, 1]
    df = layered(
        spark,
        sound(),
        ("null", full, None, full, full, 2, "t", None),
        ("ragged", full, full, [0], full, 2, "t", None),
        ("empty", [], [], [], [], 2, "t", None),
        ("code", full, full, full, [0, None], 2, "t", None),
        ("len", full, full, full, full, None, "t", None),
        ("text", full, full, full, full, 2, None, None),
        ("long", full, full, full, full, 9999, "t", None),
    )
    found = {r.row_key: r.error for r in frames.build_errors(df).collect()}
    assert found == {
        "ok": None,
        "null": "null_layer",
        "ragged": "ragged_layers",
        "empty": "empty_layers",
        "code": "null_code",
        "len": "null_encoded_len",
        "text": "null_text",
        "long": None,
    }
    kept = training.sound_rows(df, max_seconds=30)
    assert [r.row_key for r in kept.collect()] == ["ok"]
    rejected = {r.row_key for r in training.rejected_rows(df, max_seconds=30).collect()}
    assert rejected == {"null", "ragged", "empty", "code", "len", "text"}
    # without a limit the length is not needed
    unlimited = {r.row_key for r in training.sound_rows(df, max_seconds=None).collect()}
    assert unlimited == {"ok", "len", "long"}


def test_fail_mode(spark):
    df = layered(spark, sound(), ("null", None, [1], [1], [1], 1, "t", None))
    with pytest.raises(PySparkException, match="null_layer"):
        training.sound_rows(df, max_seconds=30, on_error="fail").collect()
    assert training.sound_rows(layered(spark, sound()), max_seconds=30, on_error="fail").count() == 1


def test_drop_empty_codes(spark):
    df = spark.createDataFrame([([1],), ([],), (None,)], "codes_list array<int>")
    assert frames.drop_empty_codes(df).count() == 1


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "y")], "x int, y string")
    assert sorted(tuple(r) for r in rows.union_sources([a, b]).collect()) == [(1, None), (2, "y")]
    with pytest.raises(ValueError):
        rows.union_sources([])


def test_downmix(spark):
    df = spark.createDataFrame([([[1.0, 3.0], [0.0, -1.0]],)], "s array<array<double>>")
    assert df.select(fx.mono_downmix("s")).first()[0] == [2.0, -0.5]
    assert df.select(fx.mono_downmix("s", channels=2)).first()[0] == [2.0, -0.5]
