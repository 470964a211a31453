from __future__ import annotations

import hashlib
import zlib

import pytest

from voxloom.llm import merkle as mk

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, path string, hash int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root, and per leaf its steps (left sibling, right sibling)."""
    steps, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            left = nodes[at - 1] if at % 2 else None
            right = nodes[at + 1] if at % 2 == 0 and at + 1 < len(nodes) else None
            steps[k].append((left or "", right or ""))
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        where = [at // 2 for at in where]
    return nodes[0], steps


def brute(rows):
    if not rows:
        return []
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in g]) for x, g in groups.items()}
    root, upper = tree([trees[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for row, steps in zip(groups[x], trees[x][1]):
            path = steps + upper[k]
            node = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                node = leaf((*row[:3], row[3] + 1, row[4]))
            for left, right in path:
                node = sha(left, node, right)
            out.append((row[0], leaf(row), trees[x][0], root, sha(*(s for p in path for s in p)), node, node == root))
    return sorted(out, key=str)


def got(spark, rows, how):
    df = spark.createDataFrame([(*r, "k", "p", 1) for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, mk.manifest(df, how).collect()), key=str)


def some(n, lang, first=0):
    return [(first + i, f"s{i % 3}", lang, 3 * i, f"text {i} é") for i in range(n)]


ODD = [
    (None, None, None, None, None), (None, "s", None, 5, ""), (7, "s", None, None, "x"), (7, "s", "é", 9, "x" * 50_000),
    (7, "s", "é", 9, "x" * 50_000), (21, "s", "", 9, ""), (21, "s", "", 9, None), (2**63 - 1, "s", "\U0001f600", 2**63 - 1, "￿"),
]


@pytest.mark.parametrize("digits", [2, 8])
@pytest.mark.parametrize("sizes", [(1,), (2, 1, 3, 4, 5), (16, 17, 1, 33, 65)])
def test_equals_the_definition(spark, digits, sizes):
    rows = [r for k, n in enumerate(sizes) for r in some(n, f"l{k}", 100 * k)]
    assert got(spark, rows, mk.Manifest(digits=digits)) == brute(rows)


@pytest.mark.parametrize("bound", [0, 500_000])
def test_odd_rows_and_copies(spark, bound):
    rows = ODD + some(40, "en") + some(30, "en", 10) + [(5, "s", "en", 1, "copy")] * 60
    assert got(spark, rows, mk.Manifest(digits=3, partition_rows=20, bound=bound)) == brute(rows)


def test_empty_table_and_many_languages(spark):
    assert got(spark, [], mk.Manifest()) == []
    rows = [(i, "s", f"l{i * 7 % 41}", 1, "t") for i in range(90)]
    assert got(spark, rows, mk.Manifest(digits=2)) == brute(rows)


def test_a_block_is_shuffled_once(spark):
    rows = spark.createDataFrame([("k", i, 64, str(i), (i,)) for i in range(64)], "key string, rank long, n long, hash string, item struct<id: long>")
    plan = mk.rolled(rows, 4, mk.Manifest(digits=4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "collect_list" not in plan
