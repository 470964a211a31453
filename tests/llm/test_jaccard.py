from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from llm_texts import prose

from voxloom.llm.components import components
from voxloom.llm.jaccard import JaccardJoin, divide_skip, jaccard_classes, shingle_set


def brute(rows, how):
    sets = [set(shingle_set(t, how.words).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and how.links(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                parent[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        same = [rows[j][0] for j in range(len(rows)) if sets[j] == sets[i] and rows[j][0] is not None]
        component, own = (min(x) if sets[i] and x else doc_id for x in (ids, same))
        out.append((doc_id, len(sets[i]), component, own, links[i]))
    return Counter(out)


def copies(count, seed, words=60, edits=2):
    draw = random.Random(seed)
    base = prose(seed, words).split()
    texts = []
    for _ in range(count):
        text = list(base)
        for _ in range(draw.randrange(edits + 1)):
            text[draw.randrange(len(text))] = f"new{draw.randrange(1000)}"
        texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("how", [JaccardJoin(4, 85), JaccardJoin(5, 80, chunk_docs=7), JaccardJoin(2, 50, chunk_docs=5)])
def test_equals_brute_force(documents, odd_texts, how):
    texts = odd_texts + copies(40, 3) + copies(25, 4, words=200, edits=6) + [prose(s, 30) for s in range(50, 80)]
    ids = list(range(len(texts)))
    random.Random(5).shuffle(ids)
    ids[1], ids[20], ids[21] = None, None, ids[22]  # no id; an id that two rows have
    rows = list(zip(ids, texts)) + list(zip(ids[30:40], texts[30:40]))  # rows that repeat
    docs = documents([t for _, t in rows], [i for i, _ in rows])
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.class_id, r.n_links) for r in jaccard_classes(docs, how).collect())
    assert got == brute(rows, how)


def test_whole_table_twice(documents):
    texts = copies(10, 8) + [prose(s, 30) for s in range(10)]
    docs = documents(texts)
    def found(df):
        return Counter((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in jaccard_classes(df).collect())

    once, twice = found(docs), found(docs.coalesce(1).union(docs.coalesce(1)))
    assert twice == Counter({k: 2 * v for k, v in once.items()})


def test_without_broadcasts(documents, odd_texts, monkeypatch):
    """What a corpus beyond the bound of broadcast tables takes."""
    from voxloom.llm import common, jaccard

    pick = common.pick_rows
    monkeypatch.setattr(jaccard, "pick_rows", lambda *a, **k: pick(*a, **k, bound=0))
    how = JaccardJoin(3, 70, chunk_docs=6)
    texts = odd_texts + copies(20, 3) + [odd_texts[6]] * 30
    ids = [None if i % 3 == 0 else i for i in range(len(texts))]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.class_id, r.n_links) for r in jaccard_classes(documents(texts, ids), how).collect())
    assert got == brute(list(zip(ids, texts)), how)


def test_empty_table(documents):
    assert jaccard_classes(documents([])).collect() == []


def test_divide_skip_counts_like_a_scan():
    draw = random.Random(9)
    for _ in range(200):
        lists = [sorted(draw.sample(range(30), draw.randrange(1, 25))) for _ in range(draw.randrange(1, 15))]
        need = draw.randrange(1, len(lists) + 1)
        counts = Counter(x for one in lists for x in one)
        want = {x: c for x, c in counts.items() if c >= need}
        assert dict(divide_skip(lists, need)) == want


def test_words_are_ascii_runs():
    assert len(shingle_set("A b\x0bC\x1fd e", 3)) == 1
    assert (shingle_set("A B c D", 2) == shingle_set("a\tb\nc d", 2)).all()
    assert (shingle_set("É b c", 2) != shingle_set("é b c", 2)).any()
    assert shingle_set("a b", 4) != shingle_set("a b c", 4)


def test_components_of_chains_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3), (200, 199), (200, 201)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {199: 199, 200: 199, 201: 199}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_long_text_is_whole():
    text = prose(1, 30_000)
    assert len(shingle_set(text, 8)) == len({tuple(text.split()[i : i + 8]) for i in range(30_000 - 7)})
    assert shingle_set(text, 8).dtype == np.uint64
