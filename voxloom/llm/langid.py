"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of fixed length that overlap by one byte
less than the widest filter, so that no filter loses a place at a border.  Each byte
has a small vector; filters of several widths run over them, the highest value of
each filter in a window passes a rectifier, and a softmax layer gives the window's
language.  All windows of a whole text are read; a text's probabilities are the mean
of its windows', weighted by their bytes of letters.

Training is numpy only, on a bounded sample of labelled rows; see ``LanguageModel``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import blocks, held_out, row_and

BLOCK_BYTES = 4_000_000
PAD = 255  # no byte of UTF-8
UNKNOWN = "und"
_HASHES = 1 << 40
_LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or 128 <= b < PAD for b in range(256)])
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)  # A-Z as a-z


@dataclass(frozen=True)
class LanguageModel:
    """Sizes of the network and bounds of its training.

    The ``languages`` most frequent languages are learned, from ``per_language``
    documents each at most, the ones with the smallest hash of their id; of these
    ``per_document`` windows each, spread over the first ``max_chars`` code points.
    While training, a ``cut_share`` of the windows end early, so that short texts are
    known too.  Whatever is predicted is read whole.
    """

    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    width: int = 8
    languages: int = 200
    per_language: int = 600
    per_document: int = 4
    cut_share: float = 0.3
    max_chars: int = 20_000
    epochs: int = 8
    batch: int = 128
    rate: float = 0.01
    seed: int = 5

    @property
    def stride(self) -> int:
        return self.window - max(self.widths) + 1


class Windows:
    """The windows of texts that lie one after the other in ``data``.

    ``begin`` and ``size`` say where each text is.  A text of no bytes has no window;
    behind a text's end a window holds ``PAD``.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, how: LanguageModel):
        overlap = how.window - how.stride
        self.counts = np.where(size > 0, np.maximum(1, -(-(size - overlap) // how.stride)), 0)
        self.owner = np.repeat(np.arange(len(size)), self.counts)
        before = np.cumsum(self.counts) - self.counts
        offset = (np.arange(len(self.owner)) - before[self.owner]) * how.stride
        self.start = begin[self.owner] + offset
        self.left = size[self.owner] - offset
        padded = np.concatenate((data, np.full(how.window, PAD, np.uint8)))
        self.views = np.lib.stride_tricks.sliding_window_view(padded, how.window)

    def take(self, which: np.ndarray) -> np.ndarray:
        found = self.views[self.start[which]]
        short = self.left[which] < found.shape[1]
        if short.any():
            found[short] = np.where(np.arange(found.shape[1]) < self.left[which][short, None], found[short], PAD)
        return _FOLDED[found]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column as they lie in memory, and each text's begin and size; null: none."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    present = np.asarray(column.is_valid())
    return flat, offsets[:-1], np.where(present, np.diff(offsets), 0)


def start_weights(classes: int, how: LanguageModel) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(how.seed)
    n, widest = how.filters * len(how.widths), max(how.widths)
    weights = {
        "bytes": draw.normal(0, 0.5, (256, how.width)),
        "kernel": draw.normal(0, 0.3, (widest * how.width, n)) * kernel_mask(how),
        "bias": np.zeros(n),
        "out": draw.normal(0, n**-0.5, (n, classes)),
        "out_bias": np.zeros(classes),
    }
    weights["bytes"][PAD] = 0
    return {k: v.astype(np.float32) for k, v in weights.items()}


def kernel_mask(how: LanguageModel) -> np.ndarray:
    """All filters are columns of one matrix as high as the widest; below its width a column is zero."""
    reach = np.repeat(how.widths, how.filters) * how.width
    return (np.arange(max(how.widths) * how.width)[:, None] < reach).astype(np.float32)


def patches(weights: dict, windows: np.ndarray) -> np.ndarray:
    """(windows, places, widest filter x vector): what a filter sees at each place."""
    vectors = weights["bytes"].take(windows, axis=0)
    n, length, d = vectors.shape
    flat = np.lib.stride_tricks.sliding_window_view(vectors.reshape(n, length * d), weights["kernel"].shape[0], axis=1)
    return np.ascontiguousarray(flat[:, ::d])


def softmax(logits: np.ndarray) -> np.ndarray:
    value = np.exp(logits - logits.max(axis=1, keepdims=True))
    return value / value.sum(axis=1, keepdims=True)


def forward(weights: dict, windows: np.ndarray) -> np.ndarray:
    """Probabilities of each window: (windows, languages)."""
    seen = patches(weights, windows)
    n, places, wide = seen.shape
    values = (seen.reshape(-1, wide) @ weights["kernel"]).reshape(n, places, -1)
    # The rectifier grows with its input, so it may come after the maximum.
    pooled = np.maximum(values.max(axis=1) + weights["bias"], 0)
    return softmax(pooled @ weights["out"] + weights["out_bias"])


def gradients(weights: dict, windows: np.ndarray, target: np.ndarray, how: LanguageModel) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy."""
    seen = patches(weights, windows)
    n, places, wide = seen.shape
    values = (seen.reshape(-1, wide) @ weights["kernel"]).reshape(n, places, -1)
    at = values.argmax(axis=1)
    highest = np.take_along_axis(values, at[:, None], axis=1)[:, 0] + weights["bias"]
    pooled = np.maximum(highest, 0)
    d_logit = softmax(pooled @ weights["out"] + weights["out_bias"])
    d_logit[np.arange(n), target] -= 1
    d_logit /= n
    d_value = (d_logit @ weights["out"].T) * (highest > 0)
    best = seen[np.arange(n)[:, None], at]  # (windows, filters, wide)
    d_seen = d_value[:, :, None] * weights["kernel"].T
    d_bytes = np.zeros_like(weights["bytes"])
    for k in range(max(how.widths)):
        read = windows[np.arange(n)[:, None], at + k]
        np.add.at(d_bytes, read, d_seen[:, :, k * how.width : (k + 1) * how.width])
    d_bytes[PAD] = 0
    return {
        "bytes": d_bytes,
        "kernel": np.einsum("nfw,nf->wf", best, d_value) * kernel_mask(how),
        "bias": d_value.sum(axis=0),
        "out": pooled.T @ d_logit,
        "out_bias": d_logit.sum(axis=0),
    }


def train(texts: list[str], labels: list[str], how: LanguageModel = LanguageModel()) -> dict:
    """Languages, in code point order, and weights.  No texts: no languages."""
    names = sorted(set(labels))
    model: dict = {"languages": names}
    if len(names) < 2:
        return model
    weights = start_weights(len(names), how)
    column = pa.array(texts, pa.large_string())
    data = Windows(*bytes_of(column), how)
    first = np.cumsum(data.counts) - data.counts
    chosen = [first[d] + np.unique(np.linspace(0, c - 1, how.per_document).astype(np.int64)) for d, c in enumerate(data.counts) if c]
    target = np.array([names.index(label) for label in labels], np.int64)
    chosen = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
    draw = np.random.default_rng(how.seed)
    first_moment = {k: np.zeros_like(v) for k, v in weights.items()}
    second_moment = {k: np.zeros_like(v) for k, v in weights.items()}
    step, rate = 0, how.rate
    for _ in range(how.epochs):
        order = draw.permutation(chosen)
        for s in range(0, len(order), how.batch):
            part = order[s : s + how.batch]
            step += 1
            windows = data.take(part)
            ends = np.where(draw.random(len(part)) < how.cut_share, draw.integers(4, how.window // 2, len(part)), how.window)
            windows[np.arange(how.window) >= ends[:, None]] = PAD
            for name, grad in gradients(weights, windows, target[data.owner[part]], how).items():
                m = first_moment[name] = 0.9 * first_moment[name] + 0.1 * grad
                v = second_moment[name] = 0.99 * second_moment[name] + 0.01 * grad**2
                size = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                weights[name] -= (size * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
        rate *= 0.8
    return model | weights


def predict(model: dict, column: pa.Array, how: LanguageModel = LanguageModel(), slice_windows: int = 256) -> np.ndarray:
    """Probabilities of each text, (texts, languages); a text of no bytes has zeros."""
    names = model["languages"]
    data = Windows(*bytes_of(column), how)
    total = np.zeros((len(column), len(names)))
    if len(names) < 2:
        total[data.counts > 0] = 1.0
        return total
    weight = np.zeros(len(column))
    for s in range(0, len(data.owner), slice_windows):
        which = np.arange(s, min(s + slice_windows, len(data.owner)))
        windows = data.take(which)
        # A window without letters still counts a little, so that every text has a sum.
        letters = _LETTERS[windows].sum(axis=1) + 1e-3
        np.add.at(total, data.owner[which], forward(model, windows) * letters[:, None])
        np.add.at(weight, data.owner[which], letters)
    return total / np.maximum(weight, 1e-9)[:, None]


def language_sample(docs: DataFrame, how: LanguageModel = LanguageModel()) -> tuple[list[str], list[str]]:
    """The bounded, repeatable sample that is learned from, on the driver: (texts, languages).

    Held-out rows, rows without an id, text or language are never taken.  Of several
    rows with one id the smallest language and text count.
    """
    known = docs.select("doc_id", "lang", "text").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequent = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(how.languages).collect()
    if not frequent:
        return [], []
    # The smallest hashes lie below a bound that about twice as many rows as needed pass, however many there are.
    bounds = [F.lit(x) for row in frequent for x in (row["lang"], min(_HASHES, _HASHES * (2 * how.per_language + 100) // row["count"]))]
    hashed = known.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES)).alias("hash"))
    near = hashed.where(F.col("hash") < F.try_element_at(F.create_map(*bounds), "lang"))
    ranks = Window.partitionBy("lang").orderBy("hash", "doc_id")
    ranked = near.select("lang", "doc_id", F.row_number().over(ranks).alias("rank"))
    ids = [(row["doc_id"], row["lang"]) for row in ranked.where(F.col("rank") <= how.per_language).collect()]
    chosen = docs.sparkSession.createDataFrame(sorted(set(ids)), "id long, name string")
    rows = (
        known.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("name")))
        .select("doc_id", "lang", F.substring("text", 1, how.max_chars).alias("text"))
        .collect()
    )
    best = {row["doc_id"]: row for row in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["text"]), reverse=True)}
    return [best[i]["text"] for i in sorted(best)], [best[i]["lang"] for i in sorted(best)]


def fit_language(docs: DataFrame, how: LanguageModel = LanguageModel()) -> dict:
    """Train on the bounded sample of ``lang``; see ``language_sample``."""
    return train(*language_sample(docs, how), how)


def predict_language(docs: DataFrame, model: dict, how: LanguageModel = LanguageModel()) -> DataFrame:
    """``(row, lang_pred, score)`` per row: the row as a struct, its most probable language and that
    language's probability.

    Only ``text`` is read, and whole, however long; other columns, whatever their
    names, are in ``row`` untouched.  Texts that are null or hold no letter get
    ``und`` and a score of 0, and so do all if no language was learned; with one
    language learned all others get that, with a score of 1.  Equally probable
    languages: the first by code points.  Equal texts have equal results.  An empty
    table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shipped.value
        names = np.array([*made["languages"], UNKNOWN], dtype=object)
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([*batch.columns, batch.column("row").field("text")], names=["row", "has_letter", "text"])
            for part in blocks(flat, "text", BLOCK_BYTES) if batch.num_rows else ():
                chances = predict(made, part.column("text"), how)
                known = np.asarray(part.column("has_letter")).astype(bool) & (chances.sum(axis=1) > 0 if len(names) > 1 else False)
                best = chances.argmax(axis=1) if len(names) > 1 else np.zeros(part.num_rows, np.int64)
                score = np.where(known, chances.max(axis=1, initial=0.0), 0.0)
                columns = [part.column("row"), pa.array(names[np.where(known, best, len(names) - 1)], pa.string()), pa.array(np.clip(score, 0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score"])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    rows = docs.select(F.struct("*").alias("row"), has_letter)
    return rows.mapInArrow(predicted, row_and(rows, "lang_pred string, score double"))
