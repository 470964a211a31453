"""Reproducible row order and even buckets from a hash of the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_BITS = 32


def order_hash(key: Sequence[str], seed: int) -> Column:
    """md5 of ``seed:key``; sorting by it gives a reproducible shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def hash_bucket(order: Column | str, buckets: int) -> Column:
    """Bucket 0..buckets-1, non-decreasing in ``order`` and of even expected size."""
    order = F.col(order) if isinstance(order, str) else order
    prefix = F.conv(F.substring(order, 1, PREFIX_BITS // 4), 16, 10).cast("bigint")
    return F.shiftright(prefix * F.lit(buckets).cast("bigint"), PREFIX_BITS).cast("int")


def hash_modulo(key: Sequence[str], n: int) -> Column:
    """Shard 0..n-1 from the md5 of the key, independent of any order."""
    prefix = F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key])), 1, 8)
    return F.pmod(F.conv(prefix, 16, 10).cast("bigint"), F.lit(n)).cast("int")
