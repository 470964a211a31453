from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_texts import prose  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, score double"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of ``documents`` with extra columns that clash with names the operators use."""

    def make(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, len(t or ""), "x", 0.25) for i, t, s in zip(ids, texts, sources)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make


@pytest.fixture
def odd_texts():
    """Null, empty, blank, tied, odd and very long texts."""
    return [None, "", "   \n\t ", "one", "one", "a b c", prose(1, 40), prose(1, 40), "漢字 é ▁ 😀 \x0b x", "w" * 5000, prose(2, 20_000), None]
