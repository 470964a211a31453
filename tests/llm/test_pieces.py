from __future__ import annotations

import os

import numpy as np
import pytest
from llm_texts import prose

from voxloom.llm import pieces as px

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="the model file is not present")

TEXTS = ["", "a", " ", "  two  blanks ", "▁", "a▁b ▁", "x" * 500, "漢字😀 " * 30, "é́ﬁ\x00\t\n", "ab" * 40 + "   " + "z" * 70, prose(4, 300), "the the the"]


@pytest.fixture(scope="module")
def pieces():
    return px.Pieces(MODEL)


def keys(n, seed=0):
    return np.arange(n).astype(np.uint64) + np.uint64(seed << 20)


def test_without_dropout_it_is_sentencepiece(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [t for t in TEXTS if "▁" not in t and "\x00" not in t]
    got = px.encode_texts(pieces, texts, keys(len(texts)), 0.0)
    assert [g.tolist() for g in got] == [model.encode(t) for t in texts]


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_every_segmentation_decodes_to_the_text(pieces, share):
    got = px.encode_texts(pieces, [*TEXTS, None], keys(len(TEXTS) + 1), share)
    assert [px.decode_ids(pieces, None if g is None else g.tolist()) for g in got] == [*TEXTS, None]


def test_long_words_give_what_short_ones_do(pieces, monkeypatch):
    want = px.encode_texts(pieces, TEXTS, keys(len(TEXTS)), 0.2)
    monkeypatch.setattr(px, "LONG_WORD", 0)
    assert [g.tolist() for g in px.encode_texts(pieces, TEXTS, keys(len(TEXTS)), 0.2)] == [w.tolist() for w in want]
    monkeypatch.setattr(px, "LONG_WORD", 10_000)
    monkeypatch.setattr(px, "SLICE", 50)
    assert [g.tolist() for g in px.encode_texts(pieces, TEXTS, keys(len(TEXTS)), 0.2)] == [w.tolist() for w in want]


def reference(pieces, text, key, share):
    """The agenda, one pair at a time, over the whole text."""
    points = [ord(" "), *map(ord, text)] if text else []
    symbols = [(int(pieces.chars[p]) if i else pieces.blank, i, i + 1) for i, p in enumerate(points)]
    while True:
        best = None
        for at, (a, b) in enumerate(zip(symbols, symbols[1:])):
            made = int(pieces.pair_pieces(np.array([a[0]]), np.array([b[0]]))[0])
            # Words are apart: no pair joins a blank to what stands before it unless that is a blank.
            if made < 0:
                continue
            spot = [np.array([x]) for x in (a[1], b[1], b[2])]
            if not px.kept(np.array([key]), *spot, share)[0]:
                continue
            rank = int(pieces.ranks[made])
            if best is None or rank < best[0]:
                best = (rank, at, made)
        if best is None:
            return [s[0] for s in symbols]
        _, at, made = best
        symbols[at : at + 2] = [(made, symbols[at][1], symbols[at + 1][2])]


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_equals_the_agenda_run_one_by_one(pieces, share):
    texts = [prose(s, 12) + "  end" for s in range(5)]
    got = px.encode_texts(pieces, texts, keys(5), share)
    for i, text in enumerate(texts):
        assert got[i].tolist() == reference(pieces, text, keys(5)[i], share)


def test_seeds_and_keys(spark, documents, pieces):
    docs = documents([*TEXTS, None])

    def ids(how, key=None):
        return {(r.row.doc_id): r.ids for r in px.encode(docs, pieces, how, key).collect()}

    one, again, other = ids(px.Dropout(0.2, 1)), ids(px.Dropout(0.2, 1)), ids(px.Dropout(0.2, 2))
    assert one == again != other
    plain = ids(px.Dropout(0.0))
    assert sum(map(len, filter(None, one.values()))) > sum(map(len, filter(None, plain.values())))
    assert one[len(TEXTS)] is None and one[0] == []
    back = px.decode(px.encode(docs, pieces, px.Dropout(0.2, 3)), pieces).collect()
    assert all(r.decoded == r.row.text for r in back)
    assert px.encode(documents([]), pieces).collect() == []
