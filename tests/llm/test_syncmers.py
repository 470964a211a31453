from __future__ import annotations

from collections import Counter

from llm_texts import prose
from pyspark.sql import functions as F

from voxloom.llm import syncmers as sx


def anchors(docs, column="text"):
    return {r.doc_id: [tuple(a) for a in r.found] for r in sx.with_anchors(docs.select("doc_id", column), {"found": column}).collect()}


def brute(spark, texts):
    """The same runs one by one; hashes of words, pairs and runs come from the engine."""
    words = {w for t in texts for w in (t or "").split()}
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {(a, b) for t in texts for a, b in zip((t or "").split(), (t or "").split()[1:])}
    g = {(r.a, r.b): r.g for r in spark.createDataFrame([(a, b, h[a], h[b]) for a, b in pairs], "a string, b string, x long, y long").select("a", "b", F.xxhash64("x", "y").alias("g")).collect()}
    out = []
    for t in texts:
        w = (t or "").split()
        p = [g[x] for x in zip(w, w[1:])]
        out.append([i for i in range(len(w) - 4) if min(p[i], p[i + 3]) <= min(p[i + 1], p[i + 2])])
    return out


def test_closed_syncmers_against_brute_force(spark, documents):
    texts = [prose(s, n) for s, n in enumerate([5, 6, 30, 200, 1000])]
    found = anchors(documents(texts))
    for i, places in enumerate(brute(spark, texts)):
        assert [at for at, _ in found[i]] == places
    assert 0.4 < len(found[4]) / 996 < 0.6


def test_anchors_do_not_depend_on_context(documents):
    inner = prose(1, 60)
    found = anchors(documents([inner, f"{prose(2, 20)} {inner} {prose(3, 25)}", f"x {inner}"]))
    for other, shift in ((1, 20), (2, 1)):
        moved = {(at + shift, a) for at, a in found[0]}
        assert moved <= set(found[other])


def test_short_and_odd_texts(documents, odd_texts):
    found = anchors(documents(odd_texts))
    assert [len(found[i]) for i in (0, 1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1, 1]
    assert found[3] == found[4] and found[6] == found[7] and len(found[10]) > 9000


def test_next_and_edited_texts(documents):
    texts = ["aé😀d", "", None, "xyz", "12345678", "q", "q", "only"]
    ids = [5, 40, -3, 1000, 7, None, 7, None]
    docs = documents(texts, ids)
    rows = sx.edited_by_next(docs).collect()
    assert len(rows) == 8
    got = {(r.row.doc_id, r.text): r for r in rows}
    assert got[1000, "xyz"].next_text == "" and got[1000, "xyz"].edited == "xy"
    assert got[5, "aé😀d"].next_text == "" and got[5, "aé😀d"].edited == "aé"
    assert got[40, ""].n_chars == 0 and got[40, ""].next_text in ("12345678", "q")
    last = [r for r in rows if r.row.doc_id is None]
    assert "xyz" in [r.next_text for r in last]  # after the last: the first
    assert Counter(r.next_text for r in rows) == Counter(r.text for r in rows)  # one round


def test_the_round_over_many_groups(spark, documents):
    ids = [i * i % 9973 * 3 for i in range(1, 400)] + [10**15, -(10**15)] + list(range(100_000, 100_400))
    ids = sorted(set(ids))
    rows = sx.with_next(documents([f"t{i}" for i in ids], ids)).collect()
    want = {a: f"t{b}" for a, b in zip(ids[::-1], ids[::-1][1:] + ids[-1:])}
    assert {r.row.doc_id: r.next_text for r in rows} == want and len(rows) == len(ids)
    one = sx.with_next(documents(["alone"], [3])).collect()
    assert [r.next_text for r in one] == ["alone"]
    assert sx.with_next(documents([])).collect() == []


def test_likeness(documents, spark):
    a, b = prose(1, 200), prose(2, 200)
    half = " ".join(a.split()[:100] + b.split()[:100])
    rows = spark.createDataFrame([(a, a), (a, b), (a, half), ("", ""), ("", a), (None, "")], "x string, y string")
    found = sx.with_anchors(rows, {"p": "x", "q": "y"}).select(
        sx.likeness(F.col("p"), F.col("q")).alias("n"), sx.fingerprint(F.col("p")).alias("fp"), sx.fingerprint(F.col("q")).alias("fq")
    ).collect()
    assert [round(r.n, 2) for r in found][:2] == [1.0, 0.0] and 0.2 < found[2].n < 0.45
    assert [r.n for r in found][3:] == [1.0, 0.0, 1.0]
    assert found[0].fp == found[0].fq != found[1].fq and found[3].fp == ""


def compared(spark, pairs):
    """Likeness by the engine, and from the printed fingerprints alone, one by one."""
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i int, x string, y string")
    found = sx.with_anchors(rows, {"p": "x", "q": "y"}).select(
        "i", sx.likeness(F.col("p"), F.col("q")).alias("n"), sx.fingerprint(F.col("p")).alias("fp"), sx.fingerprint(F.col("q")).alias("fq")
    ).orderBy("i").collect()
    out = []
    for r in found:
        x, y = ([(int(at), int(a, 16)) for at, a in (p.split(":") for p in f.split(",") if p)] for f in (r.fp, r.fq))
        first = [{a: at for at, a in reversed(s)} for s in (x, y)]
        gaps = Counter(first[0][a] - first[1][a] for a in sorted(first[0].keys() & first[1].keys())[: sx.ALIGNED])
        matched = 0
        if gaps:
            shift = max(gaps, key=lambda g: (gaps[g], -abs(g), g))
            matched = len({(at - shift, a) for at, a in x} & set(y))
        either = len(x) + len(y) - matched
        out.append((r.n, matched / either if either else 1.0))
    return out


def test_likeness_is_that_of_the_returned_fingerprints(spark):
    a, b = prose(1, 300), prose(2, 300)
    words = a.split()
    parts = [" ".join(words[i * 30 : i * 30 + 30]) for i in range(10)]
    one_word = " ".join(words[:100] + ["changed"] + words[101:])
    cases = [
        (a, a), (a, b), (a, one_word), (a, f"{prose(3, 40)} {a}"), (a, " ".join(parts[::-1])), (a, " ".join(words[:150])),
        (a, " ".join(words[:200] + prose(4, 7).split() + words[200:])), ("x y", "x y"), ("x y", "y x"), ("", ""), (a, ""), (None, None),
        (f"{a} " * 3, a), ("la " * 200, "la " * 90),
    ]
    got = compared(spark, cases)
    for measured, want in got:
        assert abs(measured - want) < 1e-12
    near = [n for n, _ in got]
    assert near[0] == 1.0 and near[1] < 0.02 and 0.9 < near[2] < 1.0
    assert near[3] > 0.75, "text in front only shifts"
    assert near[4] < 0.2, "passages in another order do not match"
    assert 0.4 < near[5] < 0.6 and near[6] > 0.45 and near[9] == near[11] == 1.0 and near[10] == 0.0


def test_one_changed_word_changes_the_fingerprint(spark):
    """However long the text: all anchors are printed."""
    pairs = []
    for seed in range(12):
        words = prose(seed, 800).split()
        pairs.append((" ".join(words), " ".join(words[:400] + ["changed"] + words[401:])))
    rows = spark.createDataFrame(pairs, "x string, y string")
    same = sx.with_anchors(rows, {"p": "x", "q": "y"}).where(sx.fingerprint(F.col("p")) == sx.fingerprint(F.col("q")))
    assert same.count() == 0
