"""Reproducible subsample, global shuffle, shards and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from voxloom.functions.hashing import hash_bucket, hash_modulo, order_hash
from voxloom.session import scratch_path, shuffle_partitions

SAMPLE_SEED = 42  # fixed value

# Hex digits by which a histogram that locates the n-th smallest hash refines the one before.
SAMPLE_DIGITS = 4
SAMPLE_BUCKETS = 16**SAMPLE_DIGITS

# Input bytes that a hash bucket should hold; what the optimizer says of inputs it knows no size of.
BUCKET_BYTES = 256 << 20
UNKNOWN_BYTES = 1 << 60


def bucket_offsets(bucketed: DataFrame, bucket: str) -> DataFrame:
    """``bucket, cnt, offset``: rows per bucket and rows in all buckets before it.

    The window without partition runs over one row per bucket, never over data.
    """
    counts = bucketed.groupBy(bucket).agg(F.count(F.lit(1)).alias("cnt"))
    running = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("offset", F.sum("cnt").over(running) - F.col("cnt"))


def _boundary(values: DataFrame, n: int) -> Row | None:
    """``low``, how often it occurs (``cnt``), and how many rows lie before it (``offset``), of the n-th
    smallest ``_h``, a stored column of hex digits; ``None`` if there are fewer rows.

    Histograms over ever longer prefixes: each finds the bucket of the n-th value
    among at most ``SAMPLE_BUCKETS`` pre-aggregated rows, until that holds one value.
    """
    before = 0
    digits = SAMPLE_DIGITS
    while True:
        counts = values.groupBy(F.substring("_h", 1, digits).alias("_p")).agg(
            F.count(F.lit(1)).alias("cnt"), F.min("_h").alias("low"), F.max("_h").alias("high")
        )
        running = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counts.withColumn("offset", F.sum("cnt").over(running) - F.col("cnt") + before)
        found = placed.where((F.col("offset") < n) & (F.col("offset") + F.col("cnt") >= n)).first()
        if found is None or found.low == found.high:
            return found
        values, before, digits = values.where(F.col("_h").startswith(found["_p"])), found.offset, digits + SAMPLE_DIGITS


def _stored_hashes(df: DataFrame, *columns: Column) -> DataFrame:
    path = scratch_path(df.sparkSession, "sample")
    df.select(*columns).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _take(df: DataFrame, order: Column, n: int) -> tuple[DataFrame, Row] | None:
    """The rows whose ``order`` is below the n-th smallest, and that one; ``None`` if there are fewer rows."""
    found = _boundary(_stored_hashes(df, order.alias("_h")), n)
    return None if found is None else (df.where(order < found.low), found)


def content_hash(df: DataFrame) -> Column:
    """md5 of a row's columns, whatever their names and types."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))


def subsample(
    df: DataFrame, n: int | None, *, key: Sequence[str], seed: int = SAMPLE_SEED, strict: bool = False
) -> DataFrame:
    """The ``n`` rows with the smallest hash of their key: a reproducible sample.

    A sort with a limit would send up to ``n`` whole rows from every task to one
    merging task.  Here the hashes are stored, histograms find the n-th smallest,
    and the rows are only filtered against it: no row is shuffled, and but for the key
    no column is read more than the filters of ``df`` need.

    Exactly ``n`` rows come back whatever the keys hold.  If only some rows of the
    n-th hash fit, these rows alone are told apart by their content in the same way,
    and of rows equal in everything as many copies are made as the sample still needs.
    With fewer than ``n`` rows all are returned, or the call fails if ``strict``.  Runs
    jobs when called.
    """
    if n is None:
        return df
    if n < 1:
        raise ValueError("n must be at least 1")
    order = order_hash(key, seed)
    taken = _take(df, order, n)
    if taken is None:
        if strict:
            raise ValueError(f"fewer than {n} rows")
        return df
    rows, last = taken
    left = n - last.offset
    if left == last.cnt:
        return df.where(order <= last.low)
    tied = df.where(order == last.low)
    content = content_hash(df)
    some, final = _take(tied, content, left)
    left -= final.offset
    same = tied.where(content == final.low)
    if left == final.cnt:
        return rows.unionByName(some).unionByName(same)
    copies = same.limit(1).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(left)))).drop("_copy")
    return rows.unionByName(some).unionByName(copies)


def global_shuffle(
    df: DataFrame,
    *,
    key: Sequence[str],
    seed: int = SAMPLE_SEED,
    partitions: int | None = None,
    unique: bool = True,
) -> DataFrame:
    """All rows in the order of their key's hash.

    Partition i holds the i-th slice of the hash range, so the result is in
    total order without the extra pass in which a range sort samples its input.
    A key that may repeat (``unique=False``) is hashed together with the row's
    content, so that rows of one key spread over the partitions.
    """
    n = partitions or bucket_count(df)
    order, content = unused_name(df, "_h"), unused_name(df, "_content")
    by = [*key] if unique else [*key, content]
    if not unique:
        df = df.withColumn(content, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    hashed = df.withColumn(order, order_hash(by, seed))
    return hashed.repartitionById(n, hash_bucket(order, n)).sortWithinPartitions(order, *by).drop(order, content)


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bucket_count(df: DataFrame) -> int:
    """Hash buckets for the rows of ``df``: the session's shuffle partitions, and more if the input's size
    asks for it, because buckets of this kind are neither split nor merged at run time."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < UNKNOWN_BYTES)
    return max(shuffle_partitions(df.sparkSession), known // BUCKET_BYTES)


def shard(df: DataFrame, n: int, *, key: Sequence[str], into: str = "shard") -> DataFrame:
    """Add the shard 0..n-1 of each row, from a hash of its key: no pass over other rows."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return df.withColumn(into, hash_modulo(key, n))


def shard_ranges(df: DataFrame, n: int, *, index: str, into: str = "shard") -> DataFrame:
    """Add the shard 0..n-1 of each row: ``n`` runs of consecutive row numbers.

    ``index`` numbers the rows from 0.  Sizes differ by at most one, the longer
    runs first.  The row count is the only thing taken from the whole data.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    counted = df.withColumn("_small", F.floor(total / n)).withColumn("_long", total % n)
    i, small, long = F.col(index), F.col("_small"), F.col("_long")
    in_long = i < long * (small + 1)
    number = F.when(in_long, F.floor(i / (small + 1))).otherwise(
        long + F.floor((i - long * (small + 1)) / F.greatest(small, F.lit(1)))
    )
    return counted.withColumn(into, number.cast("int")).drop("_small", "_long")


def ordered_restore(df: DataFrame, *, order: Sequence[str]) -> DataFrame:
    """Rows in source order, e.g. by ``(source_idx, row_key)``."""
    return df.orderBy(*order)
