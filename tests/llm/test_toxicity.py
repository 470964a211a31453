from __future__ import annotations

import zlib

import numpy as np
import pytest
from llm_texts import prose

from voxloom.llm import toxicity as tx
from voxloom.llm.common import held_out, labelled_sample

SMALL = tx.ToxicityModel(window=8, stride=6, width=4, hidden=3, word_rows=1 << 10, char_rows=1 << 8, epochs=4, batch=64)


def test_gradients_are_those_of_the_loss():
    how = SMALL
    draw = np.random.default_rng(1)
    weights = {k: v.astype(np.float64) for k, v in tx.start_weights(how).items()}
    weights["words"] = draw.normal(0, 0.5, weights["words"].shape)
    vectors = draw.normal(0, 1, (6, how.width))
    windows = draw.integers(0, 6, (5, how.window)).astype(np.int32)
    windows[0, 5:] = -1  # a text that ends inside its window
    target = np.array([1.0, 0, 1, 0, 1])

    def loss() -> float:
        x = tx.forward(weights, tx.project(weights, vectors), windows, {}).astype(np.float64)
        return float(np.sum(np.logaddexp(0, x) - target * x))

    kept: dict = {}
    logit = tx.forward(weights, tx.project(weights, vectors), windows, kept)
    grads, d_vectors = tx.backward(weights, vectors, windows, kept, tx._sigmoid(logit) - target)
    grads["vectors"] = d_vectors
    for name, grad in grads.items():
        table = vectors if name == "vectors" else weights[name]
        for place in [tuple(draw.integers(0, n) for n in table.shape) for _ in range(4)]:
            old, step = table[place], 1e-3
            table[place] = old + step
            up = loss()
            table[place] = old - step
            down = loss()
            table[place] = old
            assert grad[place] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-3), name


def test_pooling_with_and_without_gradients_agree():
    texts = tx.Texts([prose(1, 50), prose(2, 3), "", None], SMALL)
    weights = tx.start_weights(SMALL)
    inputs = tx.project(weights, tx.word_vectors(weights, texts.rows, texts.grams, texts.starts))
    assert np.allclose(tx.forward(weights, inputs, texts.windows), tx.forward(weights, inputs, texts.windows, {}), atol=1e-5)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 14, 15, 20, 100])
def test_windows_overlap_and_cover_the_whole_text(n):
    words = [f"w{i}" for i in range(n)]
    texts = tx.Texts(["x", " ".join(words)], SMALL)
    mine = texts.windows[texts.owner == 1]
    begin = texts.begin[texts.owner == 1]
    assert begin.tolist() == [i * SMALL.stride for i in range(len(begin))]
    covered = {b + k for b, w in zip(begin.tolist(), mine) for k in range(SMALL.window) if w[k] >= 0}
    assert covered == set(range(n)) and begin[-1] < n
    for b, w in zip(begin.tolist(), mine):
        assert w[w >= 0].tolist() == texts.words(1)[b : b + SMALL.window].tolist()


def labelled(n, seed=0):
    """Clean prose, and prose with a family of inflected words in it."""
    draw = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        words = prose(1000 * seed + i, int(draw.integers(20, 200))).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words[draw.integers(len(words))] = "grumb" + draw.choice(["le", "ling", "ler", "ly", "bed", "sters"])
        texts.append(" ".join(words))
        labels.append(float(toxic))
    return texts, np.array(labels, np.float32)


def test_it_learns_what_it_has_to():
    how = tx.ToxicityModel(window=16, stride=12, width=6, hidden=6, word_rows=1 << 12, char_rows=1 << 10, epochs=5)
    texts, y = labelled(300)
    model = tx.train(texts, y, how)
    more, z = labelled(120, seed=1)
    score, windows, at = tx.score_texts(model, [*more, "a", "", None], how)
    assert ((score[:120] >= 0.5) == (z == 1)).mean() > 0.95
    assert score[121] == score[122] and windows[121] == 0 and 0 <= score.min() and score.max() <= 1
    hit = next(i for i in range(120) if z[i] and score[i] > 0.5)
    assert any(w.startswith("grumb") for w in more[hit].split()[at[hit] : at[hit] + 16])


@pytest.mark.parametrize("how", [SMALL, tx.ToxicityModel(window=8, stride=5, width=4, hidden=3, word_rows=1 << 10, char_rows=1 << 8)])
def test_the_window_at_every_start_is_scored(how):
    """One by one: each word's state from its passage, each window pooled by itself, the highest taken."""
    weights = tx.start_weights(how)
    weights["words"] = np.random.default_rng(2).normal(0, 1, weights["words"].shape).astype(np.float32)
    texts = ["", prose(1, 100), None, prose(2, 3), prose(3, 8), prose(4, 9), "one", prose(5, 15), " ", prose(6, 41), prose(7, 7)]
    data = tx.Texts(texts, how)
    inputs = tx.project(weights, tx.word_vectors(weights, data.rows, data.grams, data.starts))
    best, at, counts = tx.best_windows(weights, data, how)
    margin = (how.window - how.stride) // 2
    for d, text in enumerate(texts):
        numbers = data.words(d)
        n = len(numbers)
        assert counts[d] == (max(1, n - how.window + 1) if n else 0)
        if not n:
            assert best[d] == weights["out_bias"][0]
            continue
        begins = list(range(0, max(1, n - how.window + how.stride), how.stride))
        score, value = np.zeros(n), np.zeros(n)
        for i in range(n):
            b = next(b for b in begins if i < b + margin + how.stride or b == begins[-1])
            passage = numbers[b : b + how.window]
            s, v = tx.word_values(weights, inputs, passage[None].astype(np.int32))
            score[i], value[i] = s[i - b, 0], v[i - b, 0]
        logits = []
        for start in range(max(1, n - how.window + 1)):
            e = np.exp(score[start : start + how.window])
            logits.append(float((e * value[start : start + how.window]).sum() / e.sum()) + weights["out_bias"][0])
        assert best[d] == pytest.approx(max(logits), abs=1e-4) and logits[at[d]] == pytest.approx(max(logits), abs=1e-4)


def test_where_a_passage_begins_does_not_decide_its_window():
    """Toxic words that no passage holds together are pooled together by the window at their own start."""
    texts, y = labelled(300)
    how = tx.ToxicityModel(window=16, stride=12, width=6, hidden=6, word_rows=1 << 12, char_rows=1 << 10, epochs=5)
    model = tx.train(texts, y, how)
    for shift in range(12):
        text = prose(50, 40 + shift) + " grumbler grumbling " + " ".join(prose(51, 9).split()) + " grumbled grumbly " + prose(52, 60)
        score, windows, at = tx.score_texts(model, [text], how)
        assert windows[0] == len(text.split()) - 15
        assert any(w.startswith("grumb") for w in text.split()[at[0] : at[0] + 16])


def test_missing_classes_give_a_constant():
    assert tx.score_texts(tx.train([], np.zeros(0, np.float32)), ["a"])[0].tolist() == [0.0]
    assert tx.score_texts(tx.train(["a", "b"], np.ones(2, np.float32)), ["a", None])[0].tolist() == [1.0, 1.0]


def test_scoring_a_table(documents, odd_texts):
    model = tx.train(*labelled(60), SMALL)
    docs = documents([*odd_texts, odd_texts[6]], [*range(len(odd_texts)), 6])
    out = tx.score_toxicity(docs, model, SMALL)
    rows = out.collect()
    assert len(rows) == len(odd_texts) + 1 and rows[0].row.score == 0.25  # the table's own column of that name
    by_text = {}
    for r in rows:
        assert 0 <= r.score <= 1
        assert by_text.setdefault(r.row.text or "", r.score) == r.score
    assert tx.score_toxicity(documents([]), model, SMALL).collect() == []


def test_the_sample_is_bounded_repeatable_and_leaves_held_out_rows(spark, documents):
    docs = documents([f"text {i}" for i in range(100)] + ["x" * 50, None], [*range(100), 7, 8])
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(100)] + [(None, 1, 1), (3, 0, 1), (5, None, 0)], "doc_id long, toxic int, text int")
    texts, y, share = labelled_sample(docs, labels, "toxic", per_class=(5, 7), max_chars=40)
    assert (y == 0).sum() == 5 and (y == 1).sum() <= 7 and 0.4 < share < 0.6
    ids = [int(t.split()[1]) for t in texts]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids) and all(i % 2 == v for i, v in zip(ids, y))
    assert labelled_sample(docs.repartition(5), labels, "toxic", per_class=(5, 7), max_chars=40)[0] == texts
    held = {r.doc_id: r.h for r in docs.select("doc_id", held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())
