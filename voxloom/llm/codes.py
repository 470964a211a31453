"""Vector code compression: product codes by a member-resident Lloyd iteration.

Vectors are cut into parts; the parts at one position share a codebook.  A part is a
member of the entry it is coded with, and lies with the other members of that entry:
rows are partitioned by (position, entry, salt).  In each round every partition
codes its resident members anew.  Members that keep their entry are written where
they are; only those that change it go through the next shuffle, to the partition
of their new entry.  Each entry then becomes the mean of its resident members, from
one partial sum per owner.

All arithmetic is on integers, so results depend on no order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from voxloom.llm.common import heat_join, stored
from voxloom.session import remove_table, scratch_path, shuffle_partitions

#: Components are held at plus or minus this, so that no sum of squares of a part overflows.
LIMIT = 1 << 24


@dataclass(frozen=True)
class Codes:
    """Parts of a vector, entries of a codebook, rounds, and the scale that makes components integers.

    ``members`` is how many parts an owner (position, entry, salt) holds on average at most.
    """

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    members: int = 50_000


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def whole_parts(vector: Column, how: Codes, length: int) -> Column:
    """The vector in integers, padded with zeros to ``parts`` times ``length``, as an array of parts."""
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * how.scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    zeros = F.array_repeat(F.lit(0), F.lit(how.parts * length) - F.array_size(vector))
    padded = F.concat(scaled, zeros)
    return F.array(*[F.slice(padded, p * length + 1, length) for p in range(how.parts)])


def first_books(rows: DataFrame, how: Codes) -> np.ndarray:
    """(parts, entries, length): the parts of the rows with the smallest ids.

    Of rows with one id that with the smallest parts; rows without an id come after all others.
    """
    first = rows.groupBy("id").agg(F.min("parts").alias("parts")).orderBy(F.col("id").asc_nulls_last()).limit(how.entries)
    return np.array([row["parts"] for row in first.collect()], np.int64).swapaxes(0, 1)


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distance of each part to each entry, exact: (parts, entries)."""
    out = np.empty((len(parts), len(book)), np.int64)
    for k, entry in enumerate(book):
        gap = parts - entry
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """An array column whose values all have one length, as rows of 64-bit integers."""
    return np.asarray(column.flatten()).reshape(-1, length).astype(np.int64) if length else np.zeros((len(column), 0), np.int64)


def code_members(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Members with ``best``, the nearest entry of their position's codebook (ties: the lower), and ``gap``,
    their squared distance to it.  No rows move."""
    shipped = members.sparkSession.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shipped.value
        for batch in batches:
            parts, position = matrix(batch.column("part"), made.shape[2]), np.asarray(batch.column("position"))
            best, gap = np.zeros(len(position), np.int32), np.zeros(len(position), np.int64)
            for p in np.unique(position):
                mine = np.flatnonzero(position == p)
                far = distances(parts[mine], made[p])
                best[mine] = far.argmin(axis=1)
                gap[mine] = far[np.arange(len(mine)), best[mine]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(gap)], names=[*batch.schema.names, "best", "gap"])

    more = [StructField("best", IntegerType()), StructField("gap", LongType())]
    return members.mapInArrow(coded, StructType([*members.schema.fields, *more]))


def owner_sums(members: DataFrame, length: int) -> DataFrame:
    """``(position, entry, n, sums)``: one row per owner and task, from the members that lie there."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            parts = matrix(batch.column("part"), length)
            keys = np.column_stack((np.asarray(batch.column("position")), np.asarray(batch.column("entry"))))
            owners, place = np.unique(keys, axis=0, return_inverse=True)
            order = np.argsort(place.ravel(), kind="stable")
            counts = np.bincount(place.ravel(), minlength=len(owners))
            sums = np.add.reduceat(parts[order], np.cumsum(counts) - counts, axis=0) if len(order) else parts
            for key, n, total in zip(map(tuple, owners.tolist()), counts.tolist(), sums):
                before = totals.get(key, (0, 0))
                totals[key] = (before[0] + n, before[1] + total)
        if totals:
            columns = [
                pa.array([p for p, _ in totals], pa.int32()),
                pa.array([e for _, e in totals], pa.int32()),
                pa.array([n for n, _ in totals.values()], pa.int64()),
                pa.array([s.tolist() for _, s in totals.values()], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["position", "entry", "n", "sums"])

    return members.select("position", "entry", "part").mapInArrow(summed, "position int, entry int, n long, sums array<long>")


def moved_books(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the floored mean of its members; entries without members stay.

    What reaches the driver is one row per component of an entry.
    """
    length = books.shape[2]
    sums = owner_sums(members, length)
    each = sums.select("position", "entry", "n", F.posexplode("sums").alias("place", "value"))
    total = each.groupBy("position", "entry", "place").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    new = books.copy()
    for row in total.collect():
        new[row["position"], row["entry"], row["place"]] = row["value"] // row["n"]
    return new


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by position, entry and place, as decimals parted by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def owned(members: DataFrame, partitions: int) -> DataFrame:
    """Send members to the partition of their owner."""
    return members.repartition(partitions, "position", "entry", "salt")


class Table:
    """A table in the shared folder that can be removed when the next one is there."""

    def __init__(self, rows: DataFrame, name: str):
        self.path = scratch_path(rows.sparkSession, name)
        rows.write.parquet(self.path)
        self.rows = rows.sparkSession.read.schema(rows.schema).parquet(self.path)

    def drop(self) -> None:
        remove_table(self.rows.sparkSession, self.path)


class Residents:
    """The members: those written where they lay (less the ones that left), and those that arrived since."""

    def __init__(self, partitions: int, stayed: Table, arrived: Table | None = None):
        self.partitions, self.stayed, self.arrived = partitions, stayed, arrived

    @property
    def members(self) -> DataFrame:
        rows = self.stayed.rows
        if self.arrived is None:
            return rows
        return rows.where("best = entry").drop("best", "gap").unionByName(self.arrived.rows)

    def migrate(self, books: np.ndarray) -> Residents:
        """Code all members, write them where they lie, and move only those whose entry changed."""
        coded = Table(code_members(self.members, books), "codes-coded")
        movers = coded.rows.where("best <> entry").withColumn("entry", F.col("best")).drop("best", "gap")
        after = Residents(self.partitions, coded, Table(owned(movers, self.partitions), "codes-arrived"))
        self.drop()
        return after

    def drop(self) -> None:
        for table in (self.stayed, self.arrived):
            if table is not None:
                table.drop()


def compress(vectors: DataFrame, how: Codes = Codes()) -> tuple[DataFrame, np.ndarray]:
    """``(id, label, code, error)`` per kept row of ``(id, vector, label)``, and the final codebooks as
    integers (parts, entries, components).

    ``code`` has two hex digits per part, its entry; ``error`` is the sum of the
    squared distances of the parts to their entries.  Vectors that are null, or hold
    null or non-finite components, take no part.  Vectors of unequal lengths, or of
    lengths that ``parts`` does not divide, count with zeros behind them.  Components
    beyond 2^24 in size after scaling count as that.  Rows that repeat stay, each with
    the same code; ids that repeat start one entry only, rows without an id start one
    after all others.  With fewer ids than entries the codebooks are that short.  No
    kept rows: no rows and empty codebooks.
    """
    if not 0 < how.entries <= 256:
        raise ValueError("a codebook holds 1 to 256 entries")
    spark = vectors.sparkSession
    kept = vectors.where(finite(F.col("vector")))
    longest = kept.agg(F.max(F.array_size("vector")).alias("n")).first()["n"]
    schema = StructType([*vectors.select("id", "label").schema.fields, StructField("code", StringType()), StructField("error", LongType())])
    if longest is None:
        return spark.createDataFrame([], schema), np.zeros((how.parts, 0, 0), np.int64)
    length = -(-longest // how.parts)
    # The rows' numbers hold once they are written, whatever is computed again later.
    whole = Table(
        kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole_parts(F.col("vector"), how, length).alias("parts")),
        "codes-vectors",
    )
    books = first_books(whole.rows, how)
    count = whole.rows.count()
    salts = 1 + count // how.members
    partitions = max(shuffle_partitions(spark), 1 + how.parts * count // (4 * how.members))
    tag = F.when(F.col("position") == 0, F.struct("id", "label")).alias("tag")
    parts = (
        whole.rows.select("row", "id", "label", F.posexplode("parts").alias("position", "part"))
        .select("row", "position", F.lit(-1).alias("entry"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), "part", tag)
    )
    first = code_members(parts, books).withColumn("entry", F.col("best")).drop("best", "gap")
    residents = Residents(partitions, Table(owned(first, partitions), "codes-members"))
    for k in range(how.rounds):
        if k:
            residents = residents.migrate(books)
        books = moved_books(residents.members, books)
    last = code_members(residents.members, books)
    digits = [F.max(F.when(F.col("position") == p, F.col("best"))).alias(f"entry_{p}") for p in range(how.parts)]
    rows = last.groupBy("row").agg(F.max("tag").alias("tag"), F.sum("gap").alias("error"), *digits)
    code = F.concat(*[F.lower(F.lpad(F.hex(f"entry_{p}"), 2, "0")) for p in range(how.parts)])
    result = stored(rows.select("tag.id", "tag.label", code.alias("code"), "error"), "codes")
    residents.drop()
    whole.drop()
    return result, books


def label_errors(coded: DataFrame) -> DataFrame:
    """Rows of ``compress`` with ``label_error``, the errors summed over equal labels, nulls together.

    A label may have most of the rows: its sum is pre-aggregated and comes to them.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    keyed = coded.select("*", key)
    sums = stored(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "codes-labels")
    return heat_join(keyed, sums, ["key"], weight="rows", total=coded.count()).drop("key")
