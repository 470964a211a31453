from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import codes as vc

SCHEMA = "id long, vector array<float>, label int, row string, entry int, code string"


def brute(rows, how):
    """Codes, errors and codebooks by plain loops."""
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    length = -(-max(len(v) for _, v, _ in kept) // how.parts)
    whole = []
    for i, v, y in kept:
        w = [math.floor(max(-vc.LIMIT, min(vc.LIMIT, float(np.float32(x)) * how.scale))) for x in v]
        w += [0] * (how.parts * length - len(w))
        whole.append((i, y, [w[p * length : (p + 1) * length] for p in range(how.parts)]))
    first = {}
    for i, _, w in whole:
        first[i] = min(first.get(i, w), w)
    starts = [first[i] for i in sorted(first, key=lambda i: (i is None, i or 0))[: how.entries]]
    books = [[s[p] for s in starts] for p in range(how.parts)]

    def nearest(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(how.rounds):
        for p in range(how.parts):
            found = [nearest(w[p], books[p])[0] for _, _, w in whole]
            for k in range(len(books[p])):
                mine = [w[p] for (_, _, w), f in zip(whole, found) if f == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for i, y, w in whole:
        best = [nearest(w[p], books[p]) for p in range(how.parts)]
        out.append((i, y, "".join(f"{k:02x}" for k, _ in best), sum(d for _, d in best)))
    return sorted(out, key=str), books


def got(spark, rows, how):
    df = spark.createDataFrame([(i, v, y, "x", 7, "y") for i, v, y in rows], SCHEMA)
    coded, books = vc.compress(df.select("id", "vector", "label"), how)
    return coded, sorted(map(tuple, coded.collect()), key=str), books.tolist()


@pytest.mark.parametrize("how", [vc.Codes(rounds=3), vc.Codes(parts=3, entries=5, rounds=4, members=20)])
def test_equals_plain_loops(spark, how):
    draw = np.random.default_rng(3)
    rows = [(int(i), draw.normal(0, 0.3, 16).astype("f4").tolist(), int(i % 3)) for i in range(120)]
    rows += [(500 + i, rows[2][1], 1) for i in range(60)]  # one text's vector in a third of the rows
    rows += [(3, rows[3][1], 0), (3, [0.5] * 16, None), (None, [0.25] * 16, None), (900, None, 1), (901, [1.0, None], 1)]
    rows += [(902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1), (904, [1e30] * 16, 1), (905, [0.1] * 7, 2), (906, [], 2)]
    coded, found, books = got(spark, rows, how)
    want, want_books = brute(rows, how)
    assert found == want and books == want_books
    sums = {}
    for _, y, _, e in want:
        sums[y] = sums.get(y, 0) + e
    for row in vc.label_errors(coded).collect():
        assert row.label_error == sums[row.label]


def test_few_rows_and_none(spark):
    how = vc.Codes(rounds=2)
    rows = [(5, [1.0] * 8, 1), (4, [0.5] * 8, 1)]
    assert got(spark, rows, how)[1:] == brute(rows, how)
    coded, found, books = got(spark, [(1, None, 2)], how)
    assert found == [] and vc.label_errors(coded).collect() == [] and vc.books_digest(np.array(books)) == vc.books_digest(np.zeros(0))
    assert got(spark, [(1, [], 2), (2, [], 3)], how)[1] == [(1, 2, "00" * 8, 0), (2, 3, "00" * 8, 0)]


def test_only_changed_members_move(spark):
    draw = np.random.default_rng(5)
    how = vc.Codes(parts=2, entries=4)
    rows = [(int(i), draw.normal(0, 0.3, 8).astype("f4").tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, label int")
    parts = df.select(
        F.col("id").alias("row"), F.posexplode(vc.whole_parts(F.col("vector"), how, 4)).alias("position", "part")
    ).select("row", "position", F.lit(-1).alias("entry"), F.lit(0).alias("salt"), "part")
    books = np.array([r["parts"] for r in df.orderBy("id").limit(4).select(vc.whole_parts(F.col("vector"), how, 4).alias("parts")).collect()]).swapaxes(0, 1)
    first = vc.code_members(parts, books).withColumn("entry", F.col("best")).drop("best", "gap")
    residents = vc.Residents(4, vc.Table(vc.owned(first, 4), "t"))
    before = {(r.row, r.position): r.entry for r in residents.members.collect()}
    new = vc.moved_books(residents.members, books)
    after = residents.migrate(new)
    now = {(r.row, r.position): r.entry for r in after.members.collect()}
    arrived = {(r.row, r.position) for r in after.arrived.rows.collect()}
    assert len(before) == len(now) == after.members.count() == 600
    assert arrived == {k for k in now if now[k] != before[k]} and 0 < len(arrived) < 300
    assert {(r.row, r.position): r.best for r in vc.code_members(after.members, new).collect()} == now
    # Coding and writing the residents needs no exchange.
    plan = vc.code_members(after.members, new)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    after.drop()
