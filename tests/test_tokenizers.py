from __future__ import annotations

import pytest

from voxloom.functions.text import arrow_tokenizer, char_tokenizer, model_file_tokenizer
from voxloom.operators.sequences import tokenize_text


def test_arrow_tokenizer(spark):
    def load():
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    df = spark.createDataFrame([("a bb ccc",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(arrow_tokenizer(load)(df.text)).collect()]
    assert got == [[1, 2, 3], None, []]


def test_model_file(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import models, pre_tokenizers

    model = tokenizers.Tokenizer(models.WordLevel({"hello": 7, "world": 8, "?": 0}, unk_token="?"))
    model.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "model.json")
    model.save(path)
    df = spark.createDataFrame([("hello world",), ("hello there",)], "text string")
    rows = tokenize_text(df, model_file_tokenizer(path)).collect()
    assert [r.text_tokens for r in rows] == [[7, 8, 2], [7, 0, 2]]


def test_start_marker_is_optional(spark):
    df = spark.createDataFrame([("ab",)], "text string")
    assert df.select(char_tokenizer()(df.text)).first()[0] == [1, 100, 101]
    assert df.select(char_tokenizer(add_start=False)(df.text)).first()[0] == [100, 101]
