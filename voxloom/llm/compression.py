"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts.  A text is compressed whole with each; the difference of the two sizes,
divided by the larger, says which kind it resembles.  A logistic regression on
that difference, the better compression ratio and the length, fitted on labelled
texts that the dictionaries have not seen, turns it into the probability of class 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.common import blocks, labelled_sample, logistic_fit, row_and, whole_rows, with_fields

BLOCK_BYTES = 4_000_000


@dataclass(frozen=True)
class QualityModel:
    """Bytes of a dictionary, zstandard level, and the bound of the labelled sample: at most
    ``per_class`` documents of class 0 and 1, of ``max_chars`` code points at most.  Scored texts
    have no bound."""

    dictionary: int = 112_640
    level: int = 3
    per_class: tuple[int, int] = (2000, 2000)
    max_chars: int = 20_000
    fit_share: float = 0.3


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples, their last bytes as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


class Compressors:
    """The two compressors of a model; made once per task."""

    def __init__(self, model: dict, level: int):
        import zstandard

        magic = b"\x37\xa4\x30\xec"  # fixed value: how a trained dictionary begins
        self.pair = []
        for data in (model["good"], model["bad"]):
            kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == magic else zstandard.DICT_TYPE_RAWCONTENT
            book = zstandard.ZstdCompressionDict(data, dict_type=kind)
            self.pair.append(zstandard.ZstdCompressor(level=level, dict_data=book, write_content_size=False))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Normalised size difference (positive: like the good ones), log ratio and log length of each text."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        good, bad = (np.array([len(c.compress(t)) for t in raw], float) for c in self.pair)
        size = np.log1p(np.array([len(t) for t in raw], float))
        return np.column_stack(((bad - good) / np.maximum(bad, good), size - np.log(np.minimum(bad, good)), size / 5))


def train(texts: list[str], labels: np.ndarray, how: QualityModel = QualityModel(), share: float | None = None) -> dict:
    """Dictionaries and calibration; a constant score if a class has fewer than two texts."""
    counts = np.bincount(labels.astype(int), minlength=2)
    if counts.min() < 2:
        return {"constant": float(labels.mean()) if len(labels) else 0.0}
    # Every class gives both parts something.
    part = np.zeros(len(labels), bool)
    for y in (0, 1):
        mine = np.flatnonzero(labels == y)
        part[mine[: max(1, int(len(mine) * how.fit_share))]] = True
    model = {}
    for name, y in (("good", 1), ("bad", 0)):
        samples = [texts[i].encode("utf-8", "surrogatepass") for i in np.flatnonzero(~part & (labels == y))]
        model[name] = build_dictionary(samples, how.dictionary)
    fit = np.flatnonzero(part)
    y = labels[fit]
    share = labels.mean() if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model["beta"] = logistic_fit(Compressors(model, how.level).features([texts[i] for i in fit]), y, weight)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, how: QualityModel = QualityModel()) -> dict:
    """Build from the bounded sample of ``labels.quality``; see ``labelled_sample``."""
    texts, y, share = labelled_sample(docs, labels, "quality", per_class=how.per_class, max_chars=how.max_chars)
    return train(texts, y, how, share)


def score_quality(docs: DataFrame, model: dict, how: QualityModel = QualityModel()) -> DataFrame:
    """``(row, score, difference)`` per row: the row as a struct, the probability of class 1, and the
    normalised size difference behind it.

    Only ``text`` is read, and whole; other columns are in ``row`` untouched,
    whatever their names.  Null counts as empty; empty texts have the score of an
    empty text.  Equal texts have equal scores.  Without labels of both classes the
    score is the share of class 1 (0 without any) and the difference null.  An
    empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shipped.value
        compressors = None if "constant" in made else Compressors(made, how.level)
        for batch in batches:
            for part in blocks(with_fields(batch, "text"), "text", BLOCK_BYTES) if batch.num_rows else ():
                if compressors is None:
                    score, gap = np.full(part.num_rows, made["constant"]), [None] * part.num_rows
                else:
                    features = compressors.features(part.column("text").to_pylist())
                    value = made["beta"][0] + features @ made["beta"][1:]
                    score, gap = 1 / (1 + np.exp(-np.clip(value, -30, 30))), features[:, 0]
                columns = [part.column("row"), pa.array(score, pa.float64()), pa.array(gap, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "score", "difference"])

    rows = whole_rows(docs)
    return rows.mapInArrow(scored, row_and(rows, "score double, difference double"))
