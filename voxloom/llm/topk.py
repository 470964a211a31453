"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, ``floor(scale * x)``, and are grouped by length into
buckets, long ones first; large buckets are cut into units.  Every query starts
with a bound: its k-th best score in a bounded set of the longest vectors.  In a
bucket whose longest vector has length ``m``, a query of length ``l`` needs a cosine
of ``bound / (l * m)`` at least.  Above 1 the bucket is skipped.  A low threshold
leaves pruning by length, a high one pruning by the query's largest coordinates;
the rest is verified by integer products, which also raise the bound.

Queries come in blocks, and a block only meets units that can hold a result of one
of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.llm.common import map_arrow, stored

_EXACT = 2.0**53


@dataclass(frozen=True)
class TopK:
    """Results per query; factor of the integers; length buckets; vectors of a unit (and of the
    starting set); queries of a block; cosine from which coordinates are used, and how many."""

    k: int = 10
    scale: float = 1024.0
    buckets: int = 32
    unit_rows: int = 4096
    block_queries: int = 512
    coordinate_from: float = 0.3
    coordinates: int = 3


def whole_numbers(vector: list | None, scale: float) -> list[int] | None:
    """``floor(scale * x)`` of each component, exactly; None for a null vector and for null or non-finite components."""
    from math import floor, isfinite

    if vector is None or any(x is None or not isfinite(x) for x in vector):
        return None
    scaled = [x * scale for x in vector]
    return [floor(x) for x in scaled] if all(map(isfinite, scaled)) else None


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    """Rows padded with zeros: float64 where every product is exact, else Python integers."""
    longest = max((abs(x) for r in rows for x in r), default=0) if rows else 0
    kind = np.float64 if longest < 2**31 else object
    out = np.zeros((len(rows), width), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` with the vector ``b``, held to the range of a long."""
    if a.dtype != object and b.dtype != object:
        bound = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
        if bound < _EXACT:
            return (a @ b).astype(np.int64)
    wide = a.astype(object) if a.dtype == object else a.astype(np.int64).astype(object)
    other = b.astype(object) if b.dtype == object else b.astype(np.int64).astype(object)
    return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in wide @ other], np.int64) if len(a) else np.zeros(0, np.int64)


class Unit:
    """Vectors of one bucket, ordered by length, with their directions for coordinate pruning."""

    def __init__(self, ids: list[int | None], rows: list[list[int]], width: int):
        self.width = max(width, max(map(len, rows), default=0))
        matrix = _matrix(rows, self.width)
        rough = matrix.astype(np.float64)
        norms = np.sqrt((rough * rough).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        self.ids = [ids[i] for i in order.tolist()]
        self.matrix, self.norms = matrix[order], norms[order]
        self.unit = rough[order] / np.maximum(self.norms, 1e-300)[:, None]
        self.longest = float(self.norms[0]) if len(norms) else 0.0

    def candidates(self, query: np.ndarray, norm: float, bound: float, how: TopK) -> np.ndarray:
        """Rows that may reach ``bound``; the slack covers rounding."""
        if bound == -np.inf or norm == 0:
            return np.arange(len(self.ids))
        need = bound / norm * (1 - 1e-9) - 1e-9 if bound > 0 else bound / norm * (1 + 1e-9) - 1e-9
        if need > self.longest:
            return np.zeros(0, np.int64)
        if need <= 0:
            return np.arange(len(self.ids))
        stop = int(np.searchsorted(-self.norms, -need, side="right"))  # length pruning
        cosine = need / self.longest
        if cosine < how.coordinate_from:
            return np.arange(stop)
        direction = query / norm
        rows = np.arange(stop)
        for f in np.argsort(-np.abs(direction))[: how.coordinates].tolist():
            x = direction[f]
            spread = np.sqrt(max(0.0, (1 - cosine**2) * (1 - x**2))) + 1e-9
            at = self.unit[rows, f]
            rows = rows[(at >= x * cosine - spread) if x >= 0 else (at <= x * cosine + spread)]
        return rows

    def best(self, query_id: int, query: list[int], bound: float, how: TopK) -> list[tuple[int, int | None]]:
        """The unit's ``k`` best ``(score, id)`` of those that reach ``bound``, own rows left out."""
        wide = max(self.width, len(query))
        vector = _matrix([query], wide)[0]
        matrix = self.matrix if wide == self.width else np.pad(self.matrix, ((0, 0), (0, wide - self.width)))
        rough = vector.astype(np.float64)
        norm = float(np.sqrt((rough * rough).sum()))
        kept: list[tuple[int, int | None]] = []
        rows = self.candidates(rough[: self.width], norm, bound, how)
        for s in range(0, len(rows), 1024):
            part = rows[s : s + 1024]
            if len(kept) >= how.k:  # the lengths fall: stop once none can reach the k-th best
                if kept[-1][0] > norm * self.norms[part[0]] * (1 + 1e-9) + 1e-6:
                    break
            scores = exact_products(matrix[part], vector)
            good = np.flatnonzero(scores >= max(bound, kept[-1][0] if len(kept) >= how.k else -np.inf))
            kept += [(int(scores[i]), self.ids[part[i]]) for i in good.tolist() if self.ids[part[i]] != query_id]
            kept = sorted(kept, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[: how.k]
        return kept


def _prepared(vectors: DataFrame, vec_id: str, vector: str, how: TopK) -> DataFrame:
    scale = how.scale

    def convert(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [whole_numbers(v, scale) for v in batch.column("v").to_pylist()]
        ids = batch.column("id").to_pylist()
        kept = [(i, r) for i, r in zip(ids, rows) if r is not None]
        # Components beyond a long are kept as text.
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in kept], pa.int64()), pa.array([[str(x) for x in r] if any(abs(x) >= 2**62 for x in r) else None for _, r in kept], pa.list_(pa.string())),
             pa.array([None if any(abs(x) >= 2**62 for x in r) else r for _, r in kept], pa.list_(pa.int64())),
             pa.array([float(sum(x * x for x in r)) ** 0.5 for _, r in kept], pa.float64())],
            names=["id", "huge", "ints", "norm"],
        )

    named = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return map_arrow(named, convert, "id long, huge array<string>, ints array<long>, norm double")


def _rows(table: pa.Table | pa.RecordBatch) -> list[list[int]]:
    return [[int(x) for x in h] if h is not None else i for h, i in zip(table.column("huge").to_pylist(), table.column("ints").to_pylist())]


def top_products(vectors: DataFrame, is_query: Column, how: TopK = TopK(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest integer products of each query with all other rows.

    ``is_query`` is a condition on ``id``.  Ties go to the smaller id; rows without
    an id are candidates after all others, never queries.  A query's own rows are
    those with its id.  Rows that repeat are candidates each; queries that repeat
    count once.  Vectors that are null or hold null or non-finite components take no
    part; of vectors of different lengths the shorter one is filled with zeros.
    Products beyond a long are held to its range.  With fewer candidates all are
    returned; an empty table gives no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepared = stored(_prepared(vectors, vec_id, vector, how).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    count = prepared.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Buckets at the quantiles of the lengths; units inside them by a hash of the row.
    parts = max(1, min(how.buckets, -(-count // how.unit_rows)))
    cuts = prepared.agg(F.percentile_approx("norm", [i / parts for i in range(1, parts)] or [1.0], 10_000)).first()[0]
    bucket = sum((F.when(F.col("norm") > c, 1).otherwise(0) for c in cuts[: parts - 1]), F.lit(0))
    placed = prepared.withColumn("bucket", bucket)
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("m"), F.max("norm").alias("top"))
    sizes = stored(sizes.select("bucket", "top", F.ceil(F.col("m") / how.unit_rows).alias("units")), "buckets")
    units = sizes.select("bucket", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("unit"))
    placed = placed.join(F.broadcast(sizes.drop("top")), "bucket")
    placed = placed.withColumn("unit", F.pmod(F.xxhash64("uid"), F.col("units"))).drop("units")

    queries = prepared.where(F.col("id").isNotNull() & is_query).dropDuplicates(["id", "huge", "ints"])
    # A bounded set of long vectors gives every query its first bound.
    first = prepared.orderBy(F.col("norm").desc(), "uid").limit(how.unit_rows).select("id", "huge", "ints").toArrow()
    start = Unit(first.column("id").to_pylist(), _rows(first), 0)
    shipped = spark.sparkContext.broadcast(start)

    def bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bounds = []
        for q, row in zip(batch.column("id").to_pylist(), _rows(batch)):
            best = shipped.value.best(q, row, -np.inf, how)
            bounds.append(float(best[-1][0]) if len(best) >= how.k else -np.inf)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.float64())], names=[*batch.schema.names, "bound"])

    columns = "id long, huge array<string>, ints array<long>, norm double, uid long"
    queries = stored(map_arrow(queries.select("id", "huge", "ints", "norm", "uid"), bounded, f"{columns}, bound double"), "queries")
    number = queries.count()
    blocks = max(1, -(-number // how.block_queries))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    # A block meets a unit if the unit's longest vector can reach one of its queries' bounds.
    need = F.when(F.col("norm") > 0, F.col("bound") / F.col("norm")).otherwise(F.lit(float("-inf")))
    reach = queries.groupBy("block").agg(F.min(need).alias("need"))
    by_unit = reach.withColumn("on", F.lit(0)).join(F.broadcast(units.withColumn("on", F.lit(0))), "on")
    meets = stored(by_unit.where(F.col("need") <= F.col("top") * (1 + 1e-9) + 1e-6).select("block", "bucket", "unit"), "meetings")
    left = queries.join(meets, "block").select("block", "bucket", "unit", "id", "huge", "ints", "bound")
    right = placed.join(meets, ["bucket", "unit"]).select("block", "bucket", "unit", "id", "huge", "ints")

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if asked.num_rows and there.num_rows:
            unit = Unit(there.column("id").to_pylist(), _rows(there), 0)
            for q, row, bound in zip(asked.column("id").to_pylist(), _rows(asked), asked.column("bound").to_pylist()):
                found += [(q, v, score) for score, v in unit.best(q, row, bound, how)]
        names = (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()))
        return pa.table({n: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate(names)})

    key = ["block", "bucket", "unit"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
