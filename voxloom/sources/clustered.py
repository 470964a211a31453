"""Encoded rows stored by ranges of their hash: shuffled once, when they are written.

A table has a fixed number of buckets; bucket i holds the rows whose key hashes into
the i-th slice of the hash range, so that the buckets, each sorted, are the global
shuffle.  It is stored as a bucketed table: windows by bucket need no exchange, and
ranks, sequences and batches are made where the rows are read.  Another source is
added as one more file per bucket; nothing that is there is written again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions.hashing import hash_bucket, order_hash
from voxloom.operators.sampling import SAMPLE_SEED, bucket_offsets
from voxloom.session import folder_names

# What Spark's bucketing hashes.  Its value for slice i is one that Spark puts into its bucket i.
SLOT = "_b"
ORDER = "_h"


@dataclass(frozen=True)
class ClusteredTable:
    """A clustered table below ``path``; ``key`` identifies a row in all of it."""

    path: str
    key: Sequence[str]
    buckets: int
    seed: int = SAMPLE_SEED

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> ClusteredTable:
        """The table that has been written to ``path``."""
        spec = spark.read.parquet(f"{path.rstrip('/')}/spec").first()
        return cls(path, tuple(spec["key"]), spec["buckets"], spec["seed"])

    @property
    def _rows(self) -> str:
        return f"{self.path.rstrip('/')}/rows"

    def _name(self, spark: SparkSession) -> str:
        """The table's name in the session's catalog, which only has to find its files."""
        return f"voxloom_{hashlib.md5(self._rows.encode()).hexdigest()}"

    def _slots(self, spark: SparkSession) -> DataFrame:
        """``(_bucket, _b)``, one row per bucket: the smallest number that Spark puts into that bucket."""
        draws = spark.range(64 + 32 * self.buckets).select(F.col("id").cast("int").alias("slot"))
        placed = draws.groupBy(F.pmod(F.hash("slot"), F.lit(self.buckets)).alias("_bucket"))
        return placed.agg(F.min("slot").alias(SLOT))

    def add(self, rows: DataFrame) -> None:
        """Store rows, beside those that are there already; their columns have to be the same."""
        spark = rows.sparkSession
        if self.buckets < 1:
            raise ValueError("buckets must be at least 1")
        fresh = "_SUCCESS" not in folder_names(spark, f"{self.path.rstrip('/')}/spec")
        if fresh:
            spec = spark.createDataFrame([(list(self.key), self.buckets, self.seed)], "key array<string>, buckets int, seed int")
            spec.coalesce(1).write.mode("overwrite").parquet(f"{self.path.rstrip('/')}/spec")
        elif (found := ClusteredTable.at(spark, self.path)) != ClusteredTable(self.path, tuple(self.key), self.buckets, self.seed):
            raise ValueError(f"{self.path!r} holds a table with other settings: {found}")
        else:
            self._table(spark)
        hashed = rows.withColumn(ORDER, order_hash(self.key, self.seed)).withColumn("_bucket", hash_bucket(ORDER, self.buckets))
        placed = hashed.join(F.broadcast(self._slots(spark)), "_bucket")  # one row per bucket
        placed = placed.repartitionById(self.buckets, F.col("_bucket"))
        writer = placed.write.format("parquet").mode("append").option("path", self._rows)
        writer.bucketBy(self.buckets, SLOT).sortBy(ORDER, *self.key).saveAsTable(self._name(spark))

    def _table(self, spark: SparkSession) -> DataFrame:
        name = self._name(spark)
        if not spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(self._rows).schema)
            sort = ", ".join(f"`{c}`" for c in (ORDER, *self.key))
            spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet"
                f" CLUSTERED BY (`{SLOT}`) SORTED BY ({sort}) INTO {self.buckets} BUCKETS LOCATION '{self._rows}'"
            )
        spark.catalog.refreshTable(name)  # what others have added
        return spark.table(name)

    def ranked(self, spark: SparkSession) -> DataFrame:
        """All rows with ``rank``, their place in the global shuffle, from 0; partition i holds the i-th slice.

        No row moves: a row's place in its bucket is added to the number of rows in
        the buckets before, which is counted from two narrow columns.
        """
        table = self._table(spark)
        counts = bucket_offsets(table.select("_bucket"), "_bucket")
        within = Window.partitionBy(SLOT).orderBy(ORDER, *self.key)
        numbered = table.withColumn("_rn", F.row_number().over(within)).join(F.broadcast(counts), "_bucket")
        return numbered.withColumn("rank", F.col("offset") + F.col("_rn") - 1).drop("_rn", "_bucket", ORDER)

    def read(self, spark: SparkSession) -> DataFrame:
        """The stored rows with their ``rank``."""
        return self.ranked(spark).drop(SLOT, "cnt", "offset")
