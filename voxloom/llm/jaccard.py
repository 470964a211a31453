"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two documents link when their sets of word shingles overlap enough.  A document
of ``n`` shingles can only link if at least ``T = ceil(share * n)`` of them occur
elsewhere, so three steps find all links without pairing documents up:

1. *Inverted lists.*  Every block of texts sends its distinct shingles, as packed
   arrays, to hash buckets that count them over all documents.  Each document
   learns which of its shingles repeat.  With fewer than ``T`` it has no link.
   The others keep their rarest ``repeats - T + 1`` repeated shingles: any two
   linking documents have one of these in common.
2. *Clusters.*  Documents with a common rare shingle belong to one cluster, found
   through one star per shingle.  Clusters are packed or cut, by set size, into
   bounded chunks.
3. *T-occurrence search* within a chunk or a pair of chunks whose sizes can match:
   the lists of a query are split as DivideSkip does; the short ones are merged on
   a heap, the long ones probed by binary search, and whoever reaches the required
   overlap is linked.  Every candidate is verified.  A task returns stars of its local
   components and, per document, the number of its links, never pairs.

Documents of equal sets are one class throughout; a link of a class counts as many
links as the other class has documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.llm.common import blocks, map_arrow, pick_rows, salted_join, stored
from voxloom.llm.components import components

BLOCK_BYTES = 4_000_000  # text per inverted block of a map task
MERGE_WEIGHT = 0.01  # DivideSkip's mu: cost of a heap step against a probe


@dataclass(frozen=True)
class JaccardJoin:
    """Shingle width, the least Jaccard share as a percentage, and sizes of the work units."""

    words: int = 5
    percent: int = 80
    bucket_chars: int = 2_000_000
    chunk_docs: int = 800

    def least(self, n: np.ndarray | int):
        """Overlap that any partner of a set of ``n`` must have with it."""
        return -(-self.percent * n // 100)

    def links(self, overlap: int, a: int, b: int) -> bool:
        return 100 * overlap >= self.percent * (a + b - overlap)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text.

    Words are runs of other than ASCII white space, with A-Z lower-cased.  A text
    of fewer than ``width`` words is one shingle; one without words has none.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    count = len(words) - width + 1
    mixed = np.zeros(count, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


PROFILE = "doc_id long, n long, cid string, prefix array<long>"
_PACKED = "bucket long, block long, keys binary, refs binary, counts binary, docs binary"
_FOUND = "block long, keys binary, refs binary, counts binary, docs binary"
_MANY = np.uint16(65535)


def _pack(batch: pa.RecordBatch, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket of a block: shingles with their owner, or with a count if they have several.

    ``docs`` (in one of the rows) holds what stays with the block: ids, set sizes,
    class ids and the owners of the shingles that repeat inside the block.
    """
    import pickle

    import xxhash

    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64())] + [(c, pa.binary()) for c in ("keys", "refs", "counts", "docs")])
    for part in blocks(batch, "text", BLOCK_BYTES):
        sets = [shingle_set(t.as_py(), width) for t in part.column("text")]
        ids = part.column("doc_id").to_pylist()
        sizes = np.array([len(s) for s in sets], np.int64)
        cids = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
        block = xxhash.xxh3_64_intdigest(repr((ids, cids)).encode()) >> 1
        tokens = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        # (bucket, low half of the hash) is the key of a shingle in the lists.
        bucket = (tokens >> np.uint64(32)) % np.uint64(buckets)
        keys = (bucket << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        distinct = keys[first] if len(keys) else keys
        many = counts > 1
        refs = np.where(many, _MANY, owners[first] if len(keys) else 0).astype(np.uint16)
        inside = np.repeat(many, counts)
        local = pickle.dumps((ids, sizes, cids, keys[inside], owners[inside]), protocol=5)
        home = block % buckets
        where = (distinct >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(where)) + 1
        starts, stops = np.append(0, cuts), np.append(cuts, len(where))
        rows: dict[str, list] = {c: [] for c in schema.names}
        for s, e in zip(starts.tolist(), stops.tolist()):
            if s == e:
                continue
            values = (int(where[s]), block, (distinct[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                      refs[s:e].tobytes(), counts[s:e][many[s:e]].astype(np.uint32).tobytes(), None)
            for c, v in zip(schema.names, values):
                rows[c].append(v)
        for c, v in zip(schema.names, (home, block, b"", b"", b"", local)):
            rows[c].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """Document counts of a bucket's shingles; sends each block those that repeat, with log2 of the count."""
    schema = pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in ("keys", "refs", "counts", "docs")])
    bucket = np.uint64(key[0].as_py())
    out: dict[str, list] = {c: [] for c in schema.names}
    packed = []
    for block, keys, refs, counts, docs in zip(*(table.column(c).to_pylist() for c in schema.names)):
        if docs is not None:
            for c, v in zip(schema.names, (block, None, None, None, docs)):
                out[c].append(v)
            continue
        refs = np.frombuffer(refs, np.uint16)
        seen = np.ones(len(refs), np.uint32)
        seen[refs == _MANY] = np.frombuffer(counts, np.uint32)
        packed.append((block, np.frombuffer(keys, np.uint32), refs, seen))
    if packed:
        distinct, place = np.unique(np.concatenate([p[1] for p in packed]), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate([p[3] for p in packed]), minlength=len(distinct))
        level = np.floor(np.log2(totals)).astype(np.uint8)
        repeats = totals > 1
        at = 0
        for block, keys, refs, _ in packed:
            mine = place[at : at + len(keys)]
            at += len(keys)
            keep = repeats[mine]
            if keep.any():
                full = (bucket << np.uint64(32)) | keys[keep].astype(np.uint64)
                for c, v in zip(schema.names, (block, full.tobytes(), refs[keep].tobytes(), level[mine[keep]].tobytes(), None)):
                    out[c].append(v)
    return pa.Table.from_pydict(out, schema=schema)


def _profile(table: pa.Table, least) -> pa.Table:
    """Per document of a block: set size, class and, if enough shingles repeat, the rarest of them."""
    import pickle

    rows = [table.column(c).to_pylist() for c in ("keys", "refs", "counts", "docs")]
    blocks_held = [d for d in rows[3] if d is not None]  # equal blocks, of a table that repeats, share an id
    ids, sizes, cids, inner, owners = pickle.loads(blocks_held[0])
    empty = np.zeros(0, np.uint64)
    keys = np.concatenate([empty] + [np.frombuffer(k, np.uint64) for k in rows[0] if k])
    refs = np.concatenate([np.zeros(0, np.uint16)] + [np.frombuffer(r, np.uint16) for r in rows[1] if r])
    level = np.concatenate([np.zeros(0, np.uint8)] + [np.frombuffer(c, np.uint8) for k, c in zip(rows[0], rows[2]) if k])
    if len(blocks_held) > 1:
        _, once = np.unique(np.stack((keys, refs.astype(np.uint64))), axis=1, return_index=True)
        keys, refs, level = keys[once], refs[once], level[once]
    single = refs != _MANY
    # Shingles with several owners in the block: look their level up for each owner.
    order = np.argsort(keys, kind="stable")
    found = order[np.searchsorted(keys[order], inner)] if len(inner) else np.zeros(0, np.int64)
    all_keys = np.concatenate((keys[single], inner))
    all_levels = np.concatenate((level[single], level[found])).astype(np.uint8)
    all_docs = np.concatenate((refs[single], owners)).astype(np.int64)
    repeats = np.bincount(all_docs, minlength=len(ids))
    need = least(sizes)
    wanted = np.where((sizes > 0) & (repeats >= need), repeats - need + 1, 0)
    order = np.lexsort((all_keys, all_levels, all_docs))
    all_keys, all_docs = all_keys[order], all_docs[order]
    starts = np.concatenate(([0], np.cumsum(repeats)))
    prefixes = [all_keys[s : s + w].astype(np.int64) for s, w in zip(starts[:-1].tolist(), wanted.tolist())]
    profile = pa.table(
        {"doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes), "cid": pa.array(cids, pa.string()),
         "prefix": pa.array(prefixes, pa.list_(pa.int64()))}
    )
    return pa.concat_tables([profile] * len(blocks_held))


def profiles(docs: DataFrame, how: JaccardJoin) -> DataFrame:
    """Step 1 for ``(doc_id, text)``: ``(doc_id, n, cid, prefix)`` for every row.

    ``cid`` tells equal sets; it is null for texts without words.  ``prefix`` is
    empty unless the document may link.
    """
    width, least = how.words, how.least
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, -(-int(chars) // how.bucket_chars))
    packed = map_arrow(docs.select("doc_id", "text"), lambda batch: _pack(batch, width, buckets), _PACKED)
    found = packed.groupBy("bucket").applyInArrow(_count, _FOUND)
    return found.groupBy("block").applyInArrow(lambda table: _profile(table, least), PROFILE)


def divide_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """``(position, occurrences)`` of whoever is on at least ``need`` of the sorted lists.

    The longest lists are set aside, as many as DivideSkip's rule says but fewer
    than ``need``.  The others are merged on a heap; a position seen there often
    enough to reach ``need`` is looked up in the long lists by binary search.
    """
    from bisect import bisect_left
    from heapq import merge
    from itertools import groupby
    from math import log2

    if len(lists) < need:
        return
    lists = sorted(lists, key=len, reverse=True)
    long = min(need - 1, int(need / (MERGE_WEIGHT * log2(len(lists[0]) + 1) + 1)))
    probes, short = lists[:long], lists[long:]
    for position, group in groupby(merge(*short)):
        seen = sum(1 for _ in group)
        if seen + long < need:
            continue
        for k, probe in enumerate(probes):
            if seen + long - k < need:
                break
            at = bisect_left(probe, position)
            seen += at < len(probe) and probe[at] == position
        if seen >= need:
            yield position, seen


def search(
    vids: list[int], sizes: list[int], sets: list[np.ndarray], queries: list[bool], indexed: list[bool], copies: list[int], how: JaccardJoin
) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Stars ``(root, member)`` of the components that the links among one unit's sets form, and how many
    documents each set links to (``copies`` says how many have a set).

    Queries look for indexed sets of their size or larger; both flags may be set.
    """
    from bisect import bisect_left, bisect_right

    # Of equal sizes, those that only search come first: they must see all that are indexed.
    order = sorted(range(len(vids)), key=lambda i: (sizes[i], not queries[i], vids[i]))
    vids, sizes, sets = ([x[i] for i in order] for x in (vids, sizes, sets))
    queries, indexed, copies = ([x[i] for i in order] for x in (queries, indexed, copies))
    links = [0] * len(vids)
    tokens = np.concatenate([s for s in sets] or [np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    by_token = np.argsort(tokens, kind="stable")  # owners ascend within a token
    tokens, owner = tokens[by_token], owner[by_token]
    edges = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True]))) if len(tokens) else np.zeros(1, np.int64)
    lists = {}
    flag = np.array(indexed, bool)
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if e - s > 1:
            inside = owner[s:e]
            lists[int(tokens[s])] = inside[flag[inside]].tolist()
    parent = list(range(len(vids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for q in range(len(vids)):
        if not queries[q]:
            continue
        n = sizes[q]
        need = -(-2 * how.percent * n // (100 + how.percent))
        stop = bisect_right(sizes, 100 * n // how.percent)
        mine = []
        for t in sets[q].tolist():
            entries = lists.get(t)
            if entries and entries[-1] > q:
                cut = entries[bisect_right(entries, q) : bisect_left(entries, stop)]
                if cut:
                    mine.append(cut)
        for d, overlap in divide_skip(mine, need):
            if how.links(overlap, n, sizes[d]):
                parent[root(d)] = root(q)
                links[q] += copies[d]
                links[d] += copies[q]
    stars: dict[int, list[int]] = {}
    for i in range(len(vids)):
        stars.setdefault(root(i), []).append(vids[i])
    found = [(least, v) for star in stars.values() for least in (min(star),) for v in star if v != least]
    return found, {v: n for v, n in zip(vids, links) if n}


_LINKED = "a long, b long, links long"


def _search_unit(table: pa.Table, how: JaccardJoin) -> pa.Table:
    """Stars ``(a, b)``, and ``(a, links)`` of the sets that have some here."""
    held: dict[int, list] = {}
    columns = [table.column(c).to_pylist() for c in ("vid", "n", "m", "tokens", "as_query", "as_index")]
    for vid, n, m, tokens, q, i in zip(*columns):
        row = held.setdefault(vid, [n, np.frombuffer(tokens, np.uint64), False, False, m])
        row[2] |= q
        row[3] |= i
    values = list(held.values())
    stars, links = search(list(held), *([v[k] for v in values] for k in range(5)), how)
    return pa.table(
        {"a": pa.array([a for a, _ in stars] + list(links), pa.int64()), "b": pa.array([b for _, b in stars] + [None] * len(links), pa.int64()),
         "links": pa.array([None] * len(stars) + list(links.values()), pa.int64())}
    )


def class_links(docs: DataFrame, classes: DataFrame, how: JaccardJoin) -> DataFrame:
    """Steps 2 and 3: ``(a, b)`` stars over the class numbers that link, directly or through others, and
    ``(a, links)``, how many documents of other classes a class links to, in parts to be added up."""
    count = classes.count()
    postings = classes.select("vid", F.explode("prefix").alias("tok"))
    order = F.struct(F.xxhash64("vid").alias("h"), "vid")
    leaders = (
        postings.groupBy("tok")
        .agg(F.min(order).alias("leader"), F.count("*").alias("m"))
        .where("m > 1")
        .select("tok", F.col("leader.vid").alias("a"))
    )
    shared = salted_join(postings.withColumnRenamed("vid", "b"), leaders, "tok", "inner", spread=F.xxhash64("b"), salts=8)
    clusters = components(shared.select("a", "b")).select(F.col("v").alias("vid"), F.col("root").alias("cluster"))

    members = stored(
        clusters.join(classes.select("vid", "rep", F.col("cid").alias("of"), F.col("n").alias("size"), F.col("m").alias("copies")), "vid"), "members", count
    )
    # Chunks by size: sizes are split at cumulative counts, equal sizes by a hash.
    by_size = members.groupBy("cluster", "size").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("cluster").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("cluster")
    by_size = by_size.select(
        "cluster", "size", "m", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("start"), F.sum("m").over(whole).alias("all")
    )
    chunk = F.col("start") + F.pmod(F.xxhash64("vid"), F.col("m"))
    placed = salted_join(members, by_size, ["cluster", "size"], "inner", spread=F.xxhash64("vid"), salts=8)
    placed = stored(
        placed.select(
            "vid", "rep", "of", "size", "copies", "cluster", "all", F.floor(chunk / how.chunk_docs).cast("long").alias("chunk")
        ),
        "chunks",
        count,
    )
    width = how.words

    def with_sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in blocks(batch, "text", BLOCK_BYTES):
            sets = [shingle_set(t.as_py(), width) for t in part.column("text")]
            same = [xxhash.xxh3_128_hexdigest(s.tobytes()) == c.as_py() for s, c in zip(sets, part.column("of"))]
            keep = pa.array(same)
            names = ("vid", "size", "copies", "cluster", "all", "chunk")
            columns = [part.column(c).filter(keep) for c in names]
            tokens = pa.array([s.tobytes() for s, k in zip(sets, same) if k], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, tokens], names=["vid", "n", "m", "cluster", "all", "chunk", "tokens"])

    named = placed.where("rep is not null")
    texts = pick_rows(docs.select("doc_id", "text"), named, F.col("doc_id") == F.col("rep")).drop("doc_id", "rep")
    if not placed.where("rep is null").isEmpty():
        texts = texts.unionByName(_texts_without_id(docs, placed.where("rep is null").drop("rep"), width))
    sets = map_arrow(texts, with_sets, "vid long, n long, m long, cluster long, all long, chunk long, tokens binary")
    sets = stored(sets.dropDuplicates(["vid"]), "sets")

    # Small clusters share units; each larger one has a unit per pair of chunks that can match.
    alone = sets.where(F.col("all") <= how.chunk_docs)
    packs = max(1, -(-alone.count() // how.chunk_docs))
    small = alone.select(
        F.lit(-1).cast("long").alias("u1"), F.pmod(F.xxhash64("cluster"), F.lit(packs)).alias("u2"), F.lit(-1).cast("long").alias("u3"),
        "vid", "n", "m", "tokens", F.lit(True).alias("as_query"), F.lit(True).alias("as_index"),
    )
    cut = sets.where(F.col("all") > how.chunk_docs)
    spans = cut.groupBy("cluster", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = spans.select("cluster", F.col("chunk").alias("chunk2"), F.col("lo").alias("lo2"))
    matches = (
        spans.join(other, "cluster")
        .where((F.col("chunk") <= F.col("chunk2")) & (F.col("lo2") * how.percent <= F.col("hi") * 100))
        .select("cluster", F.col("chunk").alias("i"), F.col("chunk2").alias("j"))
    )
    sides = matches.select(
        "cluster", "i", "j",
        F.explode(F.array(F.struct(F.col("i").alias("chunk"), F.lit(True).alias("q")), F.struct(F.col("j").alias("chunk"), F.lit(False).alias("q")))).alias("side"),
    ).select("cluster", "i", "j", "side.chunk", "side.q")
    large = cut.join(sides, ["cluster", "chunk"]).select(
        F.col("cluster").alias("u1"), F.col("i").alias("u2"), F.col("j").alias("u3"),
        "vid", "n", "m", "tokens", F.col("q").alias("as_query"), (~F.col("q")).alias("as_index"),
    )
    return small.unionByName(large).groupBy("u1", "u2", "u3").applyInArrow(lambda t: _search_unit(t, how), _LINKED)


def _texts_without_id(docs: DataFrame, placed: DataFrame, width: int) -> DataFrame:
    """One text of every placed class whose rows all have no id: found by the digest of its set, as ids of
    null would all meet in one task, and each with every class."""

    def digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in blocks(batch, "text", BLOCK_BYTES):
            digests = [xxhash.xxh3_128_hexdigest(shingle_set(t.as_py(), width).tobytes()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), part.column("text")], names=["digest", "text"])

    rows = docs.where("doc_id is null and text is not null").select("text")
    found = map_arrow(rows, digest, "digest string, text string").dropDuplicates(["digest"])
    return pick_rows(found, placed, F.col("digest") == F.col("of")).drop("digest")


def jaccard_classes(docs: DataFrame, how: JaccardJoin = JaccardJoin()) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id, n_links)`` for every row of ``(doc_id, text)``.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets
    of shingles.  ``component_id`` is the smallest doc_id reachable by links, the
    row's own included; ``class_id`` is the smallest doc_id of an equal set;
    ``n_links`` is the number of other rows that the row links to, equal ones included.

    Null, empty and blank texts have no shingles and no links.  Repeated rows and
    equal texts are one class.  Rows without an id take part in linking; their
    component_id is null if no linked row has an id.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    profile = stored(profiles(docs, how), "profiles")
    classes = (
        profile.where(F.size("prefix") > 0)
        .groupBy("cid")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("m"), F.first("prefix").alias("prefix"))
    )
    classes = stored(classes.withColumn("vid", F.monotonically_increasing_id()), "classes")
    found = stored(class_links(docs, classes, how), "links-found")
    grouped = components(found.where("b is not null").select("a", "b"))
    linked_to = found.where("links is not null").groupBy(F.col("a").alias("v")).agg(F.sum("links").alias("links"))
    reached = grouped.join(classes.select(F.col("vid").alias("v"), "cid", "rep"), "v").join(linked_to, "v", "left")
    smallest = reached.groupBy("root").agg(F.min("rep").alias("component"))
    linked = reached.join(smallest, "root").select("cid", "component", "links")
    same = profile.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("class"), F.count("*").alias("m"))
    known = (
        same.join(linked, "cid", "left")
        .where((F.col("m") > 1) | F.col("component").isNotNull())
        .select(
            "cid", "class", F.coalesce("component", "class").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"),
        )
    )
    spread = F.xxhash64("doc_id")
    rows = salted_join(profile.select("doc_id", "n", "cid"), known, "cid", "left", spread=spread)
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class", "doc_id").alias("class_id"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
    )
