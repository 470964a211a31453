from __future__ import annotations

import random
from collections import defaultdict

import pytest
from llm_texts import prose

from voxloom.llm import mixing as mx


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        total = sum(w[s] for s in free)
        over = [s for s in free if sizes[s] * most <= left * w[s] / total + 1e-9] if free else []
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        free -= set(over)


def table(documents, seed=3):
    draw = random.Random(seed)
    sources = [draw.choice(["b", "a", "é", "Z", None, "hot", "hot", "hot"]) for _ in range(300)] + ["tiny", "none"]
    texts = [draw.choice([None, "", prose(i, draw.randrange(1, 300))]) if i % 9 == 0 else prose(i, draw.randrange(1, 300)) for i in range(300)]
    return documents([*texts, "one two", "  "], None, sources)


def test_targets_and_totals(documents):
    docs = table(documents)
    rows = mx.mix(docs, mx.Mix(least_block=4)).collect()
    assert len(rows) == 302
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.size == len((r.row.text or "").split())
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.row.source] += r.size
        taken[r.row.source] += r.taken
        target[r.row.source] = r.target
    assert all(r.source_size == sizes[r.row.source] for r in rows)
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    again = mx.mix(docs.repartition(7), mx.Mix(least_block=4)).collect()
    assert sorted((r.row.doc_id, r.taken) for r in again) == sorted((r.row.doc_id, r.taken) for r in rows)


def test_schedule_is_low_discrepancy(spark, documents):
    docs = table(documents)
    rows = docs.select(*mx._named(), mx.words().alias("size"))
    sources = mx.targets(rows, mx.Mix(least_block=4)).persist()
    slots = sorted(mx.schedule(sources, mx.Mix(least_block=4)).collect(), key=lambda r: r.slot)
    total = sources.agg({"source_size": "sum"}).first()[0]
    assert [r.slot for r in slots] == list(range(-(-total // 4)))
    share = {r.sid: r.target / total for r in sources.collect()}
    seen = defaultdict(int)
    for k, r in enumerate(slots, start=1):
        assert r.nth == seen[r.sid] and r.first_word == r.nth * 4
        seen[r.sid] += 1
        if k % 50 == 0:
            assert all(abs(seen[s] - k * share[s]) < 6 for s in share)


def test_odd_tables(documents):
    assert mx.mix(documents([])).collect() == []
    rows = mx.mix(documents([None, "", "  "], None, ["a", None, "b"])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3
    same = mx.mix(documents([prose(1, 50)] * 6, [1] * 6, ["s"] * 6), mx.Mix(least_block=4)).collect()
    assert len({r.taken for r in same}) == 1  # rows that repeat take the same
    lost = mx.mix(documents([prose(1, 50), prose(2, 70)], [None, None], ["s", "s"])).collect()
    assert sum(r.taken for r in lost) == 120


def test_mixed_stream_follows_the_schedule(documents):
    docs = table(documents)
    docs = docs.unionByName(docs.where("doc_id % 40 = 1"))  # rows that repeat
    how = mx.Mix(least_block=4)
    rows = sorted(mx.mixed(docs, how).collect(), key=lambda r: (r.slot, r.place))
    taken, sizes, total = defaultdict(int), {}, 0
    whole = mx.mix(docs, how).collect()
    for r in whole:
        sizes[r.row.doc_id], total = r.size, total + r.size
        assert sum(x.words for x in r.rounds) == r.taken
    slots, place, inside = defaultdict(int), defaultdict(int), {}
    seen = defaultdict(list)
    for r in rows:
        assert 0 <= r.first < r.last <= sizes[r.doc_id]
        assert r.place == place[r.source]  # every source's stream is gone through without a gap
        place[r.source] += r.last - r.first
        slots[r.slot] += r.last - r.first
        assert inside.setdefault(r.slot, r.source) == r.source  # a slot is one source's
        taken[r.doc_id] += r.last - r.first
        key = (r.doc_id, r.round, r.copy)
        assert not seen[key] or seen[key][-1] == r.first  # a document's words are in order
        seen[key].append(r.last)
    # Every source takes its target; only its last slots are shorter or longer than a block.
    of = {r.row.source: r.target for r in whole}
    assert all(abs(place[s] - of[s]) <= 0.5 + 1e-6 for s in of)
    for s in of:
        own = sorted(k for k in slots if inside[k] == s)
        assert all(slots[k] == 4 for k in own[:-1]) or s == "tiny"
    rows_of = defaultdict(int)
    for r in whole:
        rows_of[r.row.doc_id] += 1
    for r in whole:
        assert r.taken == taken[r.row.doc_id] // rows_of[r.row.doc_id]
    # Any run of slots holds the sources close to their shares.
    share = {r.row.source: r.target / total for r in whole}
    count = defaultdict(int)
    for k in range(max(slots) + 1):
        if k in inside:
            count[inside[k]] += 1
        if k % 50 == 49:
            assert all(abs(count[s] - (k + 1) * share[s]) < 7 for s in share if s != "tiny")


def test_wide_tables_join_without_a_broadcast(documents, monkeypatch):
    docs = table(documents)
    docs = docs.unionByName(docs.where("doc_id % 40 = 1"))
    want = sorted((r.row.doc_id, r.taken, r.rounds) for r in mx.mix(docs).collect())
    monkeypatch.setattr(mx, "BROADCAST_ROWS", 0)
    assert sorted((r.row.doc_id, r.taken, r.rounds) for r in mx.mix(docs).collect()) == want


def test_pipeline_copies_are_interleaved(spark, documents):
    import corpus_pipeline as cp

    # Read in the order of the files, the sources alternate as the slots do.
    docs = documents([prose(i, 64) for i in range(240)] + [""], None, ["abc"[i // 80] for i in range(240)] + ["a"])
    found = [r.source for r in cp.mix_sources(spark, docs, "").collect()]
    assert found[-1] == "a"
    for k in range(60, len(found), 60):
        for s, share in (("a", 1 / 6), ("b", 2 / 6), ("c", 3 / 6)):
            assert abs(found[:k].count(s) - k * share) < 6


@pytest.mark.parametrize("sources", [8, 90])
def test_sources_below_a_block_take_their_targets(documents, sources):
    # Eight sources of twelve words beside none, then ninety of up to forty beside a large one.
    names = [f"s{i:02d}" for i in range(sources)]
    texts = [prose(i, 12 if sources == 8 else 1 + i % 40) for i in range(sources)]
    if sources > 8:
        names, texts = [*names, *["t"] * 60], [*texts, *[prose(i, 200) for i in range(60)]]
    docs = documents(texts, None, names)
    rows = mx.mix(docs).collect()
    taken, aim = defaultdict(int), {}
    for r in rows:
        assert r.taken <= 3 * r.size
        taken[r.row.source] += r.taken
        aim[r.row.source] = r.target
    assert all(abs(taken[s] - aim[s]) <= 0.5 + 1e-6 for s in aim)
    stream = mx.mixed(docs).collect()
    assert sum(r["last"] - r["first"] for r in stream) == sum(taken.values())
    seen = defaultdict(int)
    for r in sorted(stream, key=lambda r: (r.slot, r.source, r.place)):
        assert r.place == seen[r.source]
        seen[r.source] += r["last"] - r["first"]
