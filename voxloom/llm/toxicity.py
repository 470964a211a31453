"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is the sum of two vectors: one looked up by the hash of the word, one
the mean of its character trigrams'.  The network reads a text in passages of
``window`` words that overlap; two gated recurrent passes, forwards and backwards,
give a state per word, which is taken from the passage in whose middle the word lies.
Attention weights pool the states of a window, and a linear layer gives its logit.
Since every word has one state, all windows of ``window`` words are scored, at every
start of the whole text; the highest logit, with the number of windows, is calibrated
to the document's score.

Training is numpy only: labels are per document, so every epoch trains on each
document's currently highest window (multiple-instance learning).  It uses a
bounded sample of labelled rows, see ``ToxicityModel``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.common import blocks, labelled_sample, logistic_fit, map_arrow, row_and, whole_rows, with_fields

BLOCK_BYTES = 250_000  # text whose arrays a worker holds at once
# Punctuation and white space part words; A-Z are lower-cased; bytes from 128 on are letters.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)
_DIRECTIONS = ("f", "b")


@dataclass(frozen=True)
class ToxicityModel:
    """Sizes of the network and bounds of its training.

    ``per_class`` labelled documents of class 0 and 1 at most, of ``max_chars`` code
    points at most, are learned from; everything scored is scored whole.
    """

    window: int = 32
    stride: int = 24
    word_rows: int = 1 << 16
    char_rows: int = 1 << 13
    width: int = 8
    hidden: int = 8
    per_class: tuple[int, int] = (2400, 1200)
    max_chars: int = 20_000
    least_docs: int = 3
    epochs: int = 6
    batch: int = 512
    rate: float = 0.01
    seed: int = 7


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def word_features(words: list[bytes], how: ToxicityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed row of each word, its trigrams' rows one after the other, and where each word's begin."""
    from zlib import crc32

    rows = np.fromiter((crc32(w) for w in words), np.int64, len(words)) & (how.word_rows - 1)
    data = np.frombuffer(b"\1" + b"\1".join(words) + b"\1", np.uint8).astype(np.uint32)
    grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(grams), bool)
    inside[(starts[1:] - 1)] = False  # the trigram that spans a border
    grams = (grams[inside] * np.uint32(2654435761)) >> np.uint32(32 - how.char_rows.bit_length() + 1)
    return rows, grams.astype(np.int64), np.cumsum(sizes) - sizes


class Texts:
    """Texts as numbers: distinct words with their features, word numbers per text, windows."""

    def __init__(self, texts: list[str | None], how: ToxicityModel):
        words = [words_of(text) for text in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        every = list(chain.from_iterable(words))
        distinct = list(dict.fromkeys(every))
        number = dict(zip(distinct, range(len(distinct))))
        self.flat = np.fromiter(map(number.__getitem__, every), np.int32, len(every))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.count, self.size = len(distinct), len(texts)
        self.rows, self.grams, self.starts = word_features(distinct, how) if distinct else (np.zeros(0, np.int64),) * 3
        self.counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - how.window) // how.stride) + 1), 0)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        before = np.cumsum(self.counts) - self.counts
        self.begin = (np.arange(len(self.owner)) - before[self.owner]) * how.stride
        # Number of the word at each place of each window; -1 after the text's end.
        start = self.offsets[:-1][self.owner] + self.begin
        left = self.offsets[1:][self.owner] - start
        padded = np.concatenate((self.flat, np.full(how.window, -1, np.int32)))
        self.windows = np.lib.stride_tricks.sliding_window_view(padded, how.window)[start]
        short = left < how.window
        self.windows[short] = np.where(np.arange(how.window) < left[short, None], self.windows[short], -1)

    def words(self, d: int) -> np.ndarray:
        return self.flat[self.offsets[d] : self.offsets[d + 1]]


def start_weights(how: ToxicityModel) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(how.seed)
    d, h = how.width, how.hidden
    weights = {
        "words": np.zeros((how.word_rows, d)),
        "chars": draw.normal(0, 0.1, (how.char_rows, d)),
        "attend": draw.normal(0, 0.3, 2 * h),
        "out": draw.normal(0, 0.3, 2 * h),
        "out_bias": np.zeros(1),
    }
    for k in _DIRECTIONS:
        weights |= {f"in_{k}": draw.normal(0, d**-0.5, (d, 3 * h)), f"state_{k}": draw.normal(0, h**-0.5, (h, 3 * h)), f"bias_{k}": np.zeros(3 * h)}
    return {k: v.astype(np.float32) for k, v in weights.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def word_vectors(weights: dict, rows: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(starts, len(grams)))[:, None]
    return weights["words"][rows] + np.add.reduceat(weights["chars"][grams], starts, axis=0) / sizes


def _gates(matrix: np.ndarray) -> list[np.ndarray]:
    """Columns of the update gate, the reset gate and the candidate, each contiguous.

    A logistic gate is taken as a hyperbolic tangent of half its input.
    """
    parts = np.split(matrix, 3, axis=-1)
    return [np.ascontiguousarray(p) * np.float32(f) for p, f in zip(parts, (0.5, 0.5, 1.0))]


def project(weights: dict, vectors: np.ndarray) -> dict[str, list[np.ndarray]]:
    """What each distinct word adds to the gates of each direction."""
    return {k: _gates(vectors @ weights[f"in_{k}"] + weights[f"bias_{k}"]) for k in _DIRECTIONS}


def _pass(weights: dict, k: str, inputs: list[np.ndarray], windows: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction: (steps, windows, hidden)."""
    n, steps = windows.shape
    h = weights["state_f"].shape[0]
    recurrent = _gates(weights[f"state_{k}"])
    states = np.zeros((steps, n, h), np.float32)
    state = np.zeros((n, h), np.float32)
    half = np.float32(0.5)
    for t in range(steps) if k == "f" else range(steps - 1, -1, -1):
        ids = np.ascontiguousarray(windows[:, t])
        z, r, c = (x.take(ids, axis=0, mode="wrap") for x in inputs)
        z += state @ recurrent[0]
        r += state @ recurrent[1]
        u = state @ recurrent[2]
        for gate in (z, r):
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
        c += r * u
        np.tanh(c, out=c)
        new = np.subtract(state, c, out=states[t])
        new *= z
        new += c
        there = None
        if ids.min() < 0:
            there = (ids >= 0)[:, None]
            np.copyto(new, state, where=~there)
        if keep is not None:
            keep.append((t, ids, there, state, u, z, r, c))
        state = new
    return states


def word_values(weights: dict, inputs: dict, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention score of each word of the passages, and what its state gives the logit: (steps, passages)."""
    h = weights["state_f"].shape[0]
    both = [_pass(weights, k, inputs[k], windows, None) for k in _DIRECTIONS]
    found = []
    for name in ("attend", "out"):
        total = np.zeros(both[0].shape[:2], np.float32)
        for state, part in zip(both, np.split(weights[name], 2)):
            for i in range(h):  # term by term, so that a word's values do not depend on its neighbours in memory
                total += state[:, :, i] * part[i]
        found.append(total)
    return found[0], found[1]


def forward(weights: dict, inputs: dict, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window of word numbers; ``inputs`` are the projected words."""
    h = weights["state_f"].shape[0]
    both = [_pass(weights, k, inputs[k], windows, None if keep is None else keep.setdefault(k, [])) for k in _DIRECTIONS]
    scores = both[0] @ weights["attend"][:h] + both[1] @ weights["attend"][h:]
    if windows.min(initial=0) < 0:
        scores[windows.T < 0] = -1e9
    scores -= scores.max(axis=0)
    alpha = np.exp(scores, out=scores)
    alpha /= alpha.sum(axis=0)
    if keep is None:  # the pooled state is only needed through the linear layer
        values = both[0] @ weights["out"][:h] + both[1] @ weights["out"][h:]
        return (alpha * values).sum(axis=0) + weights["out_bias"][0]
    states = np.concatenate(both, axis=2)
    pooled = np.einsum("tn,tnh->nh", alpha, states)
    keep |= {"states": states, "alpha": alpha, "pooled": pooled}
    return pooled @ weights["out"] + weights["out_bias"][0]


def backward(weights: dict, vectors: np.ndarray, windows: np.ndarray, kept: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the dense weights, and of the word vectors."""
    h = weights["state_f"].shape[0]
    alpha, states, pooled = (kept[k] for k in ("alpha", "states", "pooled"))
    grads = {"out": pooled.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * weights["out"]
    d_alpha = np.einsum("tnh,nh->tn", states, d_pooled)
    d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    grads["attend"] = np.einsum("tn,tnh->h", d_score, states)
    d_states = alpha[:, :, None] * d_pooled + d_score[:, :, None] * weights["attend"]
    d_vectors = np.zeros_like(vectors)
    for j, k in enumerate(_DIRECTIONS):
        recurrent = weights[f"state_{k}"]
        d_projected = np.zeros((len(vectors), 3 * h), np.float32)
        grads[f"state_{k}"] = np.zeros_like(recurrent)
        ahead = np.zeros((windows.shape[0], h), np.float32)
        for t, ids, there, state, u, z, r, c in reversed(kept[k]):
            total = ahead + d_states[t, :, j * h : (j + 1) * h]
            d_new = total if there is None else np.where(there, total, 0)
            d_c = d_new * (1 - z) * (1 - c**2)
            d_z = d_new * (state - c) * z * (1 - z)
            d_r = d_c * u * r * (1 - r)
            d_x = np.concatenate((d_z, d_r, d_c), axis=1)
            d_u = np.concatenate((d_z, d_r, d_c * r), axis=1)
            grads[f"state_{k}"] += state.T @ d_u
            ahead = d_new * z if there is None else np.where(there, d_new * z, total)
            ahead = ahead + d_u @ recurrent.T
            if there is None:
                np.add.at(d_projected, ids, d_x)
            else:
                np.add.at(d_projected, ids[there[:, 0]], d_x[there[:, 0]])
        grads[f"in_{k}"] = vectors.T @ d_projected
        grads[f"bias_{k}"] = d_projected.sum(axis=0)
        d_vectors += d_projected @ weights[f"in_{k}"].T
    return grads, d_vectors


class _Adam:
    """Adam; of the two look-up tables only the rows that a batch touches move."""

    def __init__(self, weights: dict, rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        m = self.first[name][rows] = 0.9 * self.first[name][rows] + 0.1 * grad
        v = self.second[name][rows] = 0.99 * self.second[name][rows] + 0.01 * grad**2
        size = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        self.weights[name][rows] -= size * m / (np.sqrt(v) + 1e-7)


def _train_batch(adam: _Adam, texts: Texts, windows: np.ndarray, target: np.ndarray, usable: np.ndarray) -> None:
    weights = adam.weights
    used, local = np.unique(windows, return_inverse=True)
    local = local.reshape(windows.shape) - (used[0] < 0)
    used = used[used >= 0]
    sizes = np.diff(np.append(texts.starts, len(texts.grams)))[used]
    spans = np.repeat(texts.starts[used] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    rows, grams, starts = texts.rows[used], texts.grams[spans], np.cumsum(sizes) - sizes
    vectors = word_vectors(weights, rows, grams, starts)
    kept: dict = {}
    logit = forward(weights, project(weights, vectors), local, kept)
    d_logit = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
    grads, d_vectors = backward(weights, vectors, local, kept, d_logit)
    adam.t += 1
    for name, grad in grads.items():
        adam.step(name, grad)
    for name, at, grad in (
        ("words", rows[usable[used]], d_vectors[usable[used]]),
        ("chars", grams, np.repeat(d_vectors / sizes[:, None], sizes, axis=0)),
    ):
        which, place = np.unique(at, return_inverse=True)
        total = np.zeros((len(which), grad.shape[1]), np.float32)
        np.add.at(total, place, grad)
        adam.step(name, total, which)


def every_window(weights: dict, texts: Texts, how: ToxicityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of the windows at every start: their values, text by text, and per text where they begin and
    how many there are.  A text shorter than a window has one window, a text without words none."""
    sizes = np.diff(texts.offsets)
    counts = np.where(sizes > 0, np.maximum(1, sizes - how.window + 1), 0)
    begins = np.cumsum(counts) - counts
    if not texts.count:
        return np.zeros(0), begins, counts
    inputs = project(weights, word_vectors(weights, texts.rows, texts.grams, texts.starts))
    # Words of all texts, each text followed by as many empty places as a window may reach over its end.
    gaps = np.where(sizes > 0, how.window - 1, 0)
    first = texts.offsets[:-1] + np.cumsum(gaps) - gaps
    score = np.full(texts.offsets[-1] + gaps.sum(), -np.inf)
    value = np.zeros(len(score))
    margin = (how.window - how.stride) // 2
    steps = np.arange(how.window)
    full = texts.windows[:, -1] >= 0  # apart from the others, they need no masks
    for group in (np.flatnonzero(full), np.flatnonzero(~full)):
        for s in range(0, len(group), 2048):
            part = group[s : s + 2048]
            scores, values = word_values(weights, inputs, texts.windows[part])
            begin, left = texts.begin[part], sizes[texts.owner[part]] - texts.begin[part]
            # A passage gives the states of its middle; the first and the last one of a text also of its ends.
            low = np.where(begin == 0, 0, margin)
            high = np.where(left <= how.window, left, margin + how.stride)
            mine = (steps[:, None] >= low) & (steps[:, None] < high)
            at = (first[texts.owner[part]] + begin + steps[:, None])[mine]
            score[at], value[at] = scores[mine], values[mine]
    top = np.maximum.reduceat(score, first[sizes > 0])
    weight = np.exp(score - np.repeat(top, np.diff(np.append(first[sizes > 0], len(score)))))
    starts = len(score) - how.window + 1
    pooled, total, value = np.zeros(starts), np.zeros(starts), weight * value
    for k in range(how.window):  # word by word: a window's sum does not depend on what lies around it
        pooled += value[k : k + starts]
        total += weight[k : k + starts]
    which = np.repeat(first - begins, counts) + np.arange(counts.sum())
    return pooled[which] / total[which] + weights["out_bias"][0], begins, counts


def best_windows(weights: dict, texts: Texts, how: ToxicityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: highest logit of all windows, the first word of the first one that has it, and how many there are.

    A text without words has the logit of an empty window and no windows.
    """
    logits, begins, counts = every_window(weights, texts, how)
    best = np.full(texts.size, weights["out_bias"][0], np.float64)
    at = np.zeros(texts.size, np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        best[some] = np.maximum.reduceat(logits, begins[some])
        owner = np.repeat(np.arange(texts.size), counts)
        highest = np.flatnonzero(logits == best[owner])
        texts_hit, where = np.unique(owner[highest], return_index=True)
        at[texts_hit] = highest[where] - begins[texts_hit]
    return best, at, counts


def text_logits(weights: dict, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: highest logit of the passages it is read in, the first one that has it, and their number;
    what training goes by.

    A text without words has the logit of an empty window and no windows.
    """
    best = np.full(texts.size, weights["out_bias"][0], np.float32)
    place = np.full(texts.size, -1, np.int64)
    if texts.count:
        inputs = project(weights, word_vectors(weights, texts.rows, texts.grams, texts.starts))
        logits = np.empty(len(texts.windows), np.float32)
        full = texts.windows[:, -1] >= 0  # apart from the others, they need no masks
        for group in (np.flatnonzero(full), np.flatnonzero(~full)):
            for s in range(0, len(group), 2048):
                part = group[s : s + 2048]
                logits[part] = forward(weights, inputs, texts.windows[part])
        order = np.lexsort((-logits, texts.owner))
        owners = texts.owner[order]
        first = order[np.concatenate(([True], owners[1:] != owners[:-1]))]
        best[texts.owner[first]] = logits[first]
        place[texts.owner[first]] = first
    return best, place, texts.counts


def calibration_features(best: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.column_stack((np.clip(best, -15, 15), np.log1p(counts)))


def _informed_start(weights: dict, data: Texts, labels: np.ndarray, learn: np.ndarray, how: ToxicityModel) -> np.ndarray:
    """Put the log-odds of words and trigrams into the first column of their tables, and let the
    network read it, so that the first highest windows are sensible ones.  Returns which words occur
    in enough documents."""
    total = np.bincount(labels[learn].astype(np.int64), minlength=2)

    def odds(pairs: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
        item, doc = pairs
        counts = [np.bincount(item[labels[doc] == y], minlength=size) for y in (0, 1)]
        value = np.log((counts[1] + 1) / (total[1] + 2)) - np.log((counts[0] + 1) / (total[0] + 2))
        enough = counts[0] + counts[1] >= how.least_docs
        return np.where(enough, value, 0), enough

    docs = np.flatnonzero(learn)
    sets = [np.unique(data.words(d)) for d in docs]
    owner = np.repeat(docs, [len(s) for s in sets])
    words = np.concatenate(sets)
    value, usable = odds((words, owner), data.count)
    np.maximum.at(weights["words"][:, 0], data.rows, np.maximum(value, 0) / 2)
    np.minimum.at(weights["words"][:, 0], data.rows, np.minimum(value, 0) / 2)
    sizes = np.diff(np.append(data.starts, len(data.grams)))
    word_of = np.repeat(np.arange(data.count), sizes)
    # Trigrams by word: how much the words that hold one lean to a class, by documents of the words.
    counts = [np.bincount(words[labels[owner] == y], minlength=data.count).astype(np.float64) for y in (0, 1)]
    grams = [np.bincount(data.grams, weights=c[word_of], minlength=how.char_rows) for c in counts]
    lean = np.log((grams[1] + 1) / (grams[1].sum() + how.char_rows)) - np.log((grams[0] + 1) / (grams[0].sum() + how.char_rows))
    weights["chars"][:, 0] = np.clip(lean, -3, 3) / 2
    h = how.hidden
    for k in _DIRECTIONS:  # the first state follows the first column
        weights[f"in_{k}"][0, 2 * h] = 1.0
    weights["attend"][[0, h]] = 2.0
    weights["out"][[0, h]] = 1.5
    weights["out_bias"][0] = -1.0
    return usable


def train(texts: list[str], labels: np.ndarray, how: ToxicityModel = ToxicityModel(), share: float | None = None) -> dict[str, np.ndarray]:
    """Weights and calibration from labelled texts; a constant score if a class is missing.

    ``share`` is class 1's share of all labelled rows, if the sample has another.
    """
    if not len(labels) or labels.min() == labels.max():
        return {"constant": np.array([float(labels.mean()) if len(labels) else 0.0], np.float32)}
    draw = np.random.default_rng(how.seed)
    data = Texts(texts, how)
    weights = start_weights(how)
    adam = _Adam(weights, how.rate)
    fold = draw.random(len(labels)) < 0.2
    # A word needs a few documents to have a vector of its own; else its trigrams speak for it.
    usable = _informed_start(weights, data, labels, ~fold, how)
    first = np.cumsum(data.counts) - data.counts
    some = [d for d in range(len(labels)) if data.counts[d] and not fold[d]]
    for epoch in range(how.epochs):
        best, place, counts = text_logits(weights, data)
        chosen = []
        for d in some:
            if not labels[d]:
                chosen.append(first[d] + draw.integers(counts[d]))
            # Late in training a positive without any sign of it is taken for a wrong label.
            if not labels[d] or epoch < how.epochs // 2 or best[d] > -3:
                chosen.append(place[d])
        chosen = draw.permutation(np.array(chosen, np.int64))
        for s in range(0, len(chosen), how.batch):
            part = chosen[s : s + how.batch]
            _train_batch(adam, data, data.windows[part], labels[data.owner[part]], usable)
        adam.rate *= 0.85
    best, _, counts = best_windows(weights, data, how)
    held = fold if 0 < labels[fold].mean() < 1 else np.ones(len(labels), bool)
    features = calibration_features(best[held], counts[held])
    mine = labels.mean()
    share = mine if share is None else share
    beta = logistic_fit(features, labels[held], np.where(labels[held] == 1, share / mine, (1 - share) / (1 - mine)))
    return weights | {"calibration": beta}


def score_texts(model: dict, texts: list[str | None], how: ToxicityModel = ToxicityModel()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, number of windows and first word of the highest window of each text."""
    if "constant" in model:
        return np.full(len(texts), model["constant"][0], np.float64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    data = Texts(texts, how)
    best, at, counts = best_windows(model, data, how)
    beta = model["calibration"]
    value = beta[0] + calibration_features(best, counts) @ beta[1:]
    return 1 / (1 + np.exp(-np.clip(value, -30, 30))), counts, at


def fit_toxicity(docs: DataFrame, labels: DataFrame, how: ToxicityModel = ToxicityModel()) -> dict[str, np.ndarray]:
    """Train on the bounded sample of ``labels.toxic``; see ``labelled_sample``."""
    texts, y, share = labelled_sample(docs, labels, "toxic", per_class=how.per_class, max_chars=how.max_chars)
    return train(texts, y, how, share)


def score_toxicity(docs: DataFrame, model: dict[str, np.ndarray], how: ToxicityModel = ToxicityModel()) -> DataFrame:
    """``(row, score, n_windows, top_word)`` per row: the row as a struct, its score between 0 and 1, the
    number of windows and the first word of the highest one (the earliest, if several are).

    Only ``text`` is read; other columns, whatever their names, are in ``row``
    untouched.  Null, empty and wordless texts have no windows and the score of an
    empty one.  Equal texts, and rows that repeat, have equal scores.  Very long
    texts are scored whole.  Without labelled rows of both classes every score is
    the share of class 1 among them (0 without any).  An empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in blocks(with_fields(batch, "text"), "text", BLOCK_BYTES):
            score, windows, at = score_texts(shipped.value, part.column("text").to_pylist(), how)
            columns = [part.column("row"), pa.array(score.astype(np.float64)), pa.array(windows.astype(np.int64)), pa.array(at.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "score", "n_windows", "top_word"])

    rows = whole_rows(docs)
    return map_arrow(rows, scored, row_and(rows, "score double, n_windows long, top_word long"))
