from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import vectors as vx
from voxloom.operators import scoring


def slow_dtw(x, y):
    """Brute force over all cells; x and y are frames by features."""
    n, m = len(x), len(y)
    best = np.full((n, m), math.inf)
    for i in range(n):
        for j in range(m):
            step = math.dist(x[i], y[j])
            before = [best[a, b] for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if a >= 0 and b >= 0]
            best[i, j] = step + (min(before) if before else 0.0)
    return best[-1, -1]


def test_alignment_against_brute_force():
    rng = np.random.default_rng(7)
    shapes = [(1, 1), (1, 6), (6, 1), (2, 9), (9, 2), (5, 5), (12, 7), (7, 12), (30, 31)]
    xs = [rng.normal(size=(n, 3)) for n, _ in shapes]
    ys = [rng.normal(size=(m, 3)) for _, m in shapes]
    got = vx.alignment_cost(xs, ys)
    want = [slow_dtw(x, y) for x, y in zip(xs, ys)]
    assert np.allclose(got, want, rtol=1e-12)


def frame(spark, pairs):
    return spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a array<array<double>>, b array<array<double>>"
    )


def test_dtw_column(spark):
    rng = np.random.default_rng(3)
    pairs = [
        (rng.normal(size=(d, n)).tolist(), rng.normal(size=(d, m)).tolist())
        for d, n, m in [(13, 4, 9), (2, 8, 3), (13, 11, 11), (1, 5, 5)] * 5
    ]
    rows = frame(spark, pairs).select("id", vx.dtw_similarity("a", "b").alias("s")).collect()
    for r in rows:
        a, b = (np.array(v).T for v in pairs[r.id])
        assert r.s == pytest.approx(1 / (1 + slow_dtw(a, b) / (len(a) + len(b))), rel=1e-12)


def test_dtw_properties(spark):
    a, b = [[0.0, 1.0, 5.0]], [[0.5, 4.0]]
    df = frame(spark, [(a, a), (a, b), (b, a), (None, a), (a, None), ([[]], a)])
    s = [r.s for r in df.select("id", vx.dtw_similarity("a", "b").alias("s")).orderBy("id").collect()]
    assert s[0] == 1.0
    assert s[1] == s[2]
    assert s[3:] == [None, None, None]


def test_dtw_chunks_do_not_change_results(monkeypatch):
    rng = np.random.default_rng(5)
    xs = [rng.normal(size=(n, 2)) for n in (3, 40, 5, 17, 8)]
    ys = [rng.normal(size=(m, 2)) for m in (30, 4, 5, 11, 2)]
    whole = vx.alignment_cost(xs, ys)
    single = [vx.alignment_cost([x], [y])[0] for x, y in zip(xs, ys)]
    assert np.allclose(whole, single, rtol=1e-14)


def test_cosine_rules(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0], [1.0]), ([1.0, 0.0, 9.0], [1.0, 0.0]), ([], [1.0])],
        "a array<double>, b array<double>",
    )
    got = [r[0] for r in df.select(vx.cosine_similarity("a", "b")).collect()]
    assert got == pytest.approx([1.0, -1.0, 0.0, 1.0, 0.0])


def test_mean_pool_forms_agree(spark):
    df = spark.createDataFrame([(1, [[1.0, 3.0], [2.0, 2.0]])], "s int, mfcc array<array<double>>")
    assert df.select(vx.mean_pool("mfcc")).first()[0] == [2.0, 2.0]
    from voxloom.operators.encode import long_features

    long = long_features(df, sample="s", features=["mfcc"])
    pooled = scoring.mean_pool_long(long, by=["s", "feature", "coeff"]).orderBy("coeff").collect()
    assert [r.pooled for r in pooled] == [2.0, 2.0]


def test_overall_uses_unrounded_parts(spark):
    parts = dict.fromkeys(vx.WEIGHTS, 0.00006)
    df = spark.createDataFrame([tuple(parts.values())], list(parts))
    row = scoring.round_metrics(scoring.overall_score(df)).first()
    assert row.overall_score == 0.0001
    assert sum(vx.WEIGHTS.values()) == pytest.approx(1.0)


SAMPLE = "sample_index long, text string, " + ", ".join(f"{m} double" for m in vx.METRICS) + ", error string"


def test_summary_counts(spark):
    df = spark.createDataFrame(
        [(0, "a", 0.5, 0.5, 1.0, 0.5, 0.6, None), (1, "b", None, None, None, None, None, "x"), (2, "c", 0.7, 0.5, 1.0, 0.5, 0.8, None)],
        SAMPLE,
    )
    row = scoring.eval_summary(df).first()
    assert (row.mfcc_similarity, row.overall_score) == (0.6, 0.7)
    assert (row.samples_evaluated, row.samples_failed) == (2, 1)


def test_summary_without_scored_rows(spark):
    row = scoring.eval_summary(spark.createDataFrame([], SAMPLE)).first()
    assert [row[m] for m in vx.METRICS] == [0.0] * 5
    assert (row.samples_evaluated, row.samples_failed) == (0, 0)


def test_pair_errors(spark):
    ref = spark.createDataFrame([(0, "bad"), (1, None), (2, None), (3, None)], "sample_index long, error string")
    gen = spark.createDataFrame([(0, None), (1, "noise"), (2, None)], "sample_index long, error string")
    got = {r.sample_index: r.error for r in scoring.pair_reference_generated(ref, gen).collect()}
    assert got == {0: "bad", 1: "noise", 2: None, 3: "not_generated"}


def test_preview_is_one_hundred_characters(spark):
    from voxloom.functions.text import text_preview

    df = spark.createDataFrame([("é" * 150,), ("ab",), (None,)], "t string")
    assert [r[0] for r in df.select(text_preview("t")).collect()] == ["é" * 100, "ab", None]


def test_spectral_centroid_is_a_constant(spark):
    """One feature row pools to one number, so its cosine is 1 unless one side is silent."""
    df = spark.createDataFrame([([[3.0, 5.0]], [[100.0]]), ([[0.0, 0.0]], [[1.0]])], "a array<array<double>>, b array<array<double>>")
    got = [r[0] for r in df.select(F.round(vx.cosine_similarity(vx.mean_pool("a"), vx.mean_pool("b")), 9)).collect()]
    assert got == [1.0, 0.0]


def test_bad_features_fail_their_own_row(spark):
    good = [[float(i + j) for j in range(4)] for i in range(13)]
    chroma, centroid = good[:12], good[:1]
    cases = {
        None: {},
        "missing_features": {"mfcc": None},
        "empty_features": {"gen_mfcc": []},
        "ragged_features": {"chroma": [[1.0], [1.0, 2.0]]},
        "null_features": {"gen_centroid": [[1.0, None]]},
        "unequal_features": {"gen_mfcc": good[:12]},
    }
    rows = []
    for i, change in enumerate(cases.values()):
        row = {"mfcc": good, "chroma": chroma, "centroid": centroid}
        row |= {"gen_" + k: v for k, v in row.items()} | change
        rows.append((i, None, *[row[s + n] for s in ("", "gen_") for n in ("mfcc", "chroma", "centroid")]))
    names = ", ".join(f"{s}{n} array<array<double>>" for s in ("", "gen_") for n in ("mfcc", "chroma", "centroid"))
    out = scoring.compare_pairs(spark.createDataFrame(rows, f"sample_index int, error string, {names}"))
    got = {r.sample_index: r for r in out.collect()}
    for i, reason in enumerate(cases):
        assert got[i].error == reason
        scores = [got[i][n] for n in vx.METRICS]
        assert scores == [1.0] * 5 if reason is None else scores == [None] * 5


def test_a_nan_matrix_has_no_alignment(spark):
    df = frame(spark, [([[1.0, float("nan")]], [[1.0]]), ([[1.0, 2.0]], [[1.0, 2.0]]), ([[1.0], [2.0]], [[1.0]])])
    got = [r.s for r in df.select("id", vx.dtw_similarity("a", "b").alias("s")).orderBy("id").collect()]
    assert got == [None, 1.0, None]


def test_a_sample_generated_twice_is_an_error(spark):
    ref = spark.createDataFrame([(0, None), (1, None), (2, None)], "sample_index int, error string")
    gen = spark.createDataFrame([(0, 5), (1, 6), (1, 7)], "sample_index int, x int")
    got = {r.sample_index: (r.error, r.gen_x) for r in scoring.pair_reference_generated(ref, gen).collect()}
    assert got == {0: (None, 5), 1: ("generated_twice", None), 2: ("not_generated", None)}
