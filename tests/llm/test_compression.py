from __future__ import annotations

import numpy as np
from llm_texts import prose

from voxloom.llm import compression as cx

SMALL = cx.QualityModel(dictionary=4096)


def labelled(n, seed=0):
    texts, labels = [], []
    for i in range(n):
        text = prose(seed * 1000 + i, 40 + i % 60)
        bad = i % 3 == 0
        if bad:
            text = [" | ".join(text.split()), text.upper().replace(" ", "!! "), "Buy now. " * 40][i // 3 % 3]
        texts.append(text)
        labels.append(float(not bad))
    return texts, np.array(labels, np.float32)


def test_it_tells_kinds_apart(documents):
    model = cx.train(*labelled(240), SMALL)
    texts, y = labelled(90, seed=1)
    rows = sorted(cx.score_quality(documents(texts), model, SMALL).collect(), key=lambda r: r.row.doc_id)
    score = np.array([r.score for r in rows])
    assert ((score >= 0.5) == (y == 1)).mean() > 0.95
    assert all(-1 <= r.difference <= 1 for r in rows) and all(r.row.score == 0.25 for r in rows)


def test_the_difference_is_of_whole_compressed_texts():
    import zstandard

    model = cx.train(*labelled(240), SMALL)
    text = prose(5, 3000)
    sizes = []
    for name in ("good", "bad"):
        book = zstandard.ZstdCompressionDict(model[name])
        sizes.append(len(zstandard.ZstdCompressor(level=3, dict_data=book, write_content_size=False).compress(text.encode())))
    assert cx.Compressors(model, 3).features([text])[0][0] == (sizes[1] - sizes[0]) / max(sizes)


def test_odd_rows_and_missing_classes(documents, odd_texts):
    model = cx.train(*labelled(240), SMALL)
    rows = {r.row.doc_id: r for r in cx.score_quality(documents(odd_texts), model, SMALL).collect()}
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[0].score == rows[1].score and rows[6].score == rows[7].score
    assert cx.score_quality(documents([]), model, SMALL).collect() == []
    one = cx.score_quality(documents(["a", None]), cx.train(["x", "y"], np.ones(2, np.float32)), SMALL).collect()
    assert [(r.score, r.difference) for r in one] == [(1.0, None)] * 2
    assert cx.train([], np.zeros(0, np.float32)) == {"constant": 0.0}
    tiny = cx.train(["good text", "good words", "bad", "worse"], np.array([1, 1, 0, 0], np.float32), SMALL)
    assert 0 <= cx.score_quality(documents(["x"]), tiny, SMALL).first().score <= 1
