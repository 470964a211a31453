"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxloom.session import scratch_path

# A key set of at most this many rows (three numbers each) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000
# Narrow rows of one file of a table whose size is known.
FILE_ROWS = 250_000
# Bits of a key filter, and of one of its rows: it is broadcast, and no larger for more keys.
FILTER_BITS = 1 << 24
ROW_BITS = 32_768
# Copies of the small side of a join whose large side may hold one key in a third of its rows.
SALTS = 32


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    A table of at most ``rows`` narrow rows is written in as few files as they need.
    """
    path = scratch_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(
    large: DataFrame, small: DataFrame, on: str | Sequence[str], how: str, *, spread: Column, salts: int = SALTS, merge: bool = False
) -> DataFrame:
    """Join whose ``small`` side is copied per salt, so that no key of ``large`` meets in one task.

    ``spread`` is a hash of what tells the rows of one key apart.  With ``merge`` the
    copies are never broadcast: Spark takes them for as small as the file that they come from.
    """
    keys = [on] if isinstance(on, str) else list(on)
    left = large.withColumn("__salt", F.pmod(spread, F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge") if merge else right, [*keys, "__salt"], how).drop("__salt")


def heat_join(large: DataFrame, small: DataFrame, on: Sequence[str], *, weight: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of stored tables where ``small[weight]`` says how many rows of ``large`` have a key.

    Keys that have at least one in ``share`` of the ``total`` rows, so at most
    ``share`` of them, are broadcast and their rows stay where they are; the others
    are shuffled, and none of them can crowd a task.
    """
    hot = small.where(F.col(weight) * share >= total)
    cold = small.where(F.col(weight) * share < total)
    rest = large.join(F.broadcast(hot.select(*on)), list(on), "left_anti").join(cold, list(on))
    return large.join(F.broadcast(hot), list(on)).unionByName(rest).drop(weight)


def pick_rows(
    df: DataFrame, keys: DataFrame, condition: Column, *, how: str = "inner", bound: int = BROADCAST_ROWS
) -> DataFrame:
    """Join with a stored key table: broadcast while its counted size is small, else shuffled."""
    return df.join(F.broadcast(keys) if keys.count() <= bound else keys.hint("merge"), condition, how)


def perhaps_in(df: DataFrame, key: Column, keys: DataFrame, column: str) -> DataFrame:
    """All rows of ``df`` whose ``key``, a long hash, is in ``keys[column]``, and a few others.

    What is broadcast is a table of bits, at most ``FILTER_BITS`` of them for any number of keys.
    """
    n = F.pmod(F.col(column), F.lit(FILTER_BITS))
    bits = keys.select(n.alias("n")).groupBy(F.floor(F.col("n") / ROW_BITS).alias("__row"))
    bits = bits.agg(F.bitmap_construct_agg(F.col("n") % ROW_BITS).alias("__bits"))
    at = F.pmod(key, F.lit(FILTER_BITS))
    rows = df.withColumn("__row", F.floor(at / ROW_BITS)).withColumn("__bit", (at % ROW_BITS).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(__bits, __bit div 8 + 1, 1)")), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), "__row").withColumn("__byte", byte)
    return found.where("shiftright(__byte, __bit % 8) & 1 = 1").select(*df.columns)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32(id as text) mod 5 = 0, and rows without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def checked_join(
    large: DataFrame, small: DataFrame, on: str | Sequence[str], how: str, *, spread: Column, bound: int = BROADCAST_ROWS
) -> DataFrame:
    """Join with a stored table: broadcast while its counted size is small, else salted."""
    if small.count() <= bound:
        return large.join(F.broadcast(small), on, how)
    return salted_join(large, small, on, how, spread=spread)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, *, per_class: tuple[int, int], max_chars: int
) -> tuple[list[str], np.ndarray, float]:
    """A bounded, repeatable sample of labelled texts on the driver: (texts, 0/1 labels, share of
    class 1 among all rows that may be learned from).

    At most ``per_class[y]`` documents of class ``y``, the ones with the smallest
    hash of their id, with texts of at most ``max_chars`` code points.  Held-out
    rows are never taken.  Of several labels for one id the largest counts.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    ids = [
        row
        for y in (0, 1)
        for row in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class[y]).collect()
    ]
    if not ids:
        return [], np.zeros(0, np.float32), 0.0
    share = known.agg(F.avg("y")).first()[0]
    chosen = docs.sparkSession.createDataFrame([(r.id, r.y) for r in ids], "id long, y int")
    rows = (
        docs.select(F.col("doc_id"), F.col("text"))
        .where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
        .select("doc_id", "text", "y")
        .collect()
    )
    # One text per id; the order does not depend on partitions.
    best = {r.doc_id: (r.text, r.y) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))}
    pairs = [best[i] for i in sorted(best)]
    return [t for t, _ in pairs], np.array([y for _, y in pairs], np.float32), share


def logistic_fit(features: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton steps."""
    x = np.column_stack((np.ones(len(features)), features)).astype(np.float64)
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - labels)) + ridge @ beta
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def row_and(rows: DataFrame, more: str) -> StructType:
    """The schema of ``rows``' struct column ``row`` and of further columns."""
    return StructType([rows.schema["row"], *StructType.fromDDL(more).fields])


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch; a worker that is used again keeps no unused memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def whole_rows(df: DataFrame) -> DataFrame:
    """Every row as the struct ``row``: what a map job is sent, so that a text goes to Python once."""
    return df.select(F.struct("*").alias("row"))


def with_fields(batch: pa.RecordBatch, *names: str) -> pa.RecordBatch:
    """A batch of ``row`` structs (and other columns) with some of their fields beside them, nothing copied."""
    row = batch.column("row")
    return pa.RecordBatch.from_arrays([*batch.columns, *(row.field(n) for n in names)], names=[*batch.schema.names, *names])


def blocks(batch: pa.RecordBatch, column: str, max_bytes: int, max_rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the texts of ``column`` reach ``max_bytes``; a longer text stays whole."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    yield batch.slice(start)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
