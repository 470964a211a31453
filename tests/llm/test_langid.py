from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import prose
from pyspark.sql import functions as F

from voxloom.llm import langid as li

SMALL = li.LanguageModel(window=12, widths=(2, 3), filters=3, width=4, epochs=2, batch=8)
SPANISH = "la casa de los que con para una por el las del niño está "


def rows_of(i):
    return (prose(i, 60), "xx") if i % 2 else (" ".join(SPANISH.split()[(i + k) % 13] for k in range(60)), "es")


@pytest.fixture(scope="module")
def model():
    texts, labels = zip(*[rows_of(i) for i in range(200)])
    return li.train(list(texts), list(labels))


def one_by_one(model, text, how):
    """Probabilities of a text from the definition: each window, place and filter by itself."""
    raw = text.encode()
    overlap, total, weight = how.window - how.stride, 0.0, 0.0
    for start in range(0, max(1, len(raw) - overlap), how.stride):
        window = raw[start : start + how.window]
        letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in window) + 1e-3
        window = [b + 32 if 65 <= b <= 90 else b for b in window] + [li.PAD] * (how.window - len(window))
        pooled = []
        for f in range(how.filters * len(how.widths)):
            reach = how.widths[f // how.filters]
            values = []
            for place in range(how.stride):
                kernel = model["kernel"][:, f].reshape(-1, how.width)
                values.append(sum(float(kernel[k] @ model["bytes"][window[place + k]]) for k in range(reach)))
            pooled.append(max(0.0, max(values) + float(model["bias"][f])))
        logits = np.array(pooled) @ model["out"] + model["out_bias"]
        chance = np.exp(logits - logits.max())
        total, weight = total + letters * chance / chance.sum(), weight + letters
    return total / weight


def test_equals_the_definition():
    texts, labels = zip(*[rows_of(i) for i in range(20)])
    model = li.train(list(texts), list(labels), SMALL)
    odd = ["a", "ab", "abcdefghijkl", "abcdefghijklm", "漢字 é x", prose(3, 30), "12 34"]
    got = li.predict(model, pa.array(odd), SMALL, slice_windows=3)
    for text, chance in zip(odd, got):
        assert np.allclose(chance, one_by_one(model, text, SMALL), atol=1e-4)


def test_gradients_equal_differences():
    draw = np.random.default_rng(1)
    weights = {k: v.astype(np.float64) for k, v in li.start_weights(3, SMALL).items()}
    windows = draw.integers(97, 123, (6, SMALL.window)).astype(np.uint8)
    windows[2, 5:] = li.PAD
    target = np.array([0, 1, 2, 0, 1, 2])

    def loss():
        return -np.log(li.forward(weights, windows)[np.arange(6), target]).mean()

    for name, grad in li.gradients(weights, windows, target, SMALL).items():
        for at in zip(*(draw.integers(0, n, 12) for n in grad.shape)):
            if name == "kernel" and not li.kernel_mask(SMALL)[at]:
                continue
            if name == "bytes":
                at = (int(draw.choice(windows[windows != li.PAD])), at[1])
            before, step = weights[name][at], 1e-6
            weights[name][at] = before + step
            up = loss()
            weights[name][at] = before - step
            down = loss()
            weights[name][at] = before
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-4, name


def test_learns_and_reads_whole_texts(model):
    texts = [prose(900, 50), SPANISH, SPANISH.upper(), SPANISH + prose(901, 2000), prose(902, 20) + " " + SPANISH * 100]
    chances = li.predict(model, pa.array(texts))
    assert [model["languages"][k] for k in chances.argmax(axis=1)] == ["xx", "es", "es", "xx", "es"]
    assert np.allclose(chances.sum(axis=1), 1)


def test_rows(spark, documents, odd_texts, model):
    odd = odd_texts + ["12 34 !!", SPANISH]
    got = li.predict_language(documents(odd), model).orderBy("row.doc_id").collect()
    assert len(got) == len(odd) and got[0].row.row == "x" and got[0].row.score == 0.25
    for row, text in zip(got, odd):
        if text is None or not any(c.isalpha() for c in text):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            assert row.lang_pred in ("es", "xx") and 0 < row.score <= 1
    by_text = {}
    for row in got:
        assert by_text.setdefault(row.row.text, (row.lang_pred, row.score)) == (row.lang_pred, row.score)
    assert got[-1].lang_pred == "es"
    assert li.predict_language(documents([]), model).collect() == []


def test_sample_is_bounded_and_never_held_out(spark):
    import zlib

    rows = [(i, *rows_of(i)) for i in range(300)] + [(None, "a b", "es"), (301, None, "es"), (302, "only", None), (4, "zzz", "xx"), (4, "zzz", "xx")]
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    how = li.LanguageModel(per_language=40, max_chars=50)
    texts, labels = li.language_sample(docs, how)
    assert max(labels.count("es"), labels.count("xx")) <= 41 and min(labels.count("es"), labels.count("xx")) >= 39
    usable = {t[:50] for i, t, _ in rows if i is not None and t and zlib.crc32(str(i).encode()) % 5}
    assert set(texts) <= usable and "only" not in texts
    again = li.language_sample(docs.repartition(7), how)
    assert again == (texts, labels)


def test_without_languages(spark, documents):
    docs = documents(["abc", None, ""]).withColumn("lang", F.lit(None).cast("string"))
    got = li.predict_language(docs, li.fit_language(docs)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    one = li.predict_language(documents(["abc", "12", None]), {"languages": ["en"]}).orderBy("row.doc_id").collect()
    assert [(r.lang_pred, r.score) for r in one] == [("en", 1.0), ("und", 0.0), ("und", 0.0)]


def test_held_out_accuracy(spark, small):
    from voxloom.llm.queries import op11_byte_convolution

    got = op11_byte_convolution(spark, small).where("held_out")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9
