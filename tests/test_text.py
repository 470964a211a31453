"""Character ids and back, and detokenizers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxloom.functions.text import (
    PART_CHARS,
    _point_lists,
    arrow_detokenizer,
    batch_char_tokenizer,
    char_ids,
    char_tokenizer,
    chars_from_ids,
    text_ids,
)

TEXTS = ["", "plain", "é漢", "퟿", "", "😀 and 𐍈", "\U0010ffff", "a\x00b", "豈"]


def test_every_text_comes_back(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", char_ids("t").alias("ids"), chars_from_ids(char_ids("t")).alias("back")).collect()
    assert all(r.t == r.back for r in got)
    assert max(max(r.ids, default=0) for r in got) < 64000


def test_ids_that_spell_nothing_give_null(spark):
    bad = [[0], [3, -5], [55300], [55299 + 3, 100], [56832 + 3], [60000], [64399], [3, None], [56832 + 3, 55299 + 3]]
    df = spark.createDataFrame([(i, ids) for i, ids in enumerate([*bad, [100, 101]])], "i int, ids array<int>")
    got = {r.i: r.t for r in df.select("i", chars_from_ids("ids").alias("t")).collect()}
    assert [got[i] for i in range(len(bad))] == [None] * len(bad)
    assert got[len(bad)] == "ab"


def test_a_detokenizer_isolates_rows(spark):
    def load():
        def decode(lists):
            if any(ids == [7] for ids in lists):
                raise ValueError("unknown")
            return ["-".join(map(str, ids)) for ids in lists]

        return decode

    df = spark.createDataFrame([(0, [1, 2]), (1, [7]), (2, None), (3, [])], "i int, ids array<int>").coalesce(1)
    got = {r.i: r.t for r in df.select("i", arrow_detokenizer(load)(F.col("ids")).alias("t")).collect()}
    assert got == {0: "1-2", 1: None, 2: None, 3: ""}


def test_a_detokenizer_gets_a_bounded_number_of_ids_at_once(spark):
    long = PART_CHARS // 2 + 1

    def load():
        return lambda lists: [str(sum(map(len, lists))) for _ in lists]

    sizes = [long, long, 5, None, 3 * long, 0]
    rows = [(i, None if n is None else [9] * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "i int, ids array<int>").coalesce(1)
    got = {r.i: r.t for r in df.select("i", arrow_detokenizer(load)(F.col("ids")).alias("t")).collect()}
    assert got == {0: str(long), 1: str(long + 5), 2: str(long + 5), 3: None, 4: str(3 * long), 5: "0"}


def test_texts_are_spelled_by_batch_and_not_by_character(spark):
    df = spark.createDataFrame([([100],)], "ids array<int>").select(chars_from_ids("ids"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan


def test_ids_by_batch_are_the_ids_of_the_char_tokenizer(spark, monkeypatch):
    texts = [*TEXTS, None, "x" * 5000, "😀" * 700, "ab豈c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for add_start in (True, False):
        one, many = char_tokenizer(add_start=add_start), batch_char_tokenizer(add_start=add_start)
        got = df.select("t", one(F.col("t")).alias("a"), many(F.col("t")).alias("b"))
        assert all(r.a == r.b for r in got.collect())
        assert got.schema["a"].dataType.elementType == got.schema["b"].dataType.elementType
    monkeypatch.setattr("voxloom.functions.text.PART_CHARS", 3)  # lists leave in parts, in order
    batch = pa.array([t for t in texts], pa.string())
    parts = [x for part in _point_lists(batch, text_ids, pa.int32()) for x in part.to_pylist()]
    assert [None if x is None else len(x) for x in parts] == [None if t is None else len(text_ids(np.frombuffer(t.encode("utf-32-le"), "<i4"))) for t in texts]
