"""Merkle manifest of a dataset: every row's proof up to one root hash.

Rows are leaves; the leaves of a group, in order, make a binary tree, and the groups'
roots, in order, make another one on top.  A leaf's rank in its group is written in
binary digits.  Within a block of consecutive ranks the digits are grouped away one
after the other, lowest first: each grouping nests two child structs under their
parent's hash, and since the grouping keys of one step are a prefix of the step
before, a block is shuffled and sorted once.  The blocks' hashes are the leaves of
the next, smaller pass.  On the way down, a final transform and explode of the nested
structs emits the siblings on each leaf's path; what lies above a block comes to it
in one more grouping.  Only blocks of bounded size are ever nested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.common import BROADCAST_ROWS, checked_join, stored
from voxloom.session import shuffle_partitions

_STEP = "array<struct<left: string, right: string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Manifest:
    """Binary digits of a rank that one block groups away (a block holds two to the power of them), rows
    of a partition, and how many runs of ranks may be broadcast."""

    digits: int = 8
    partition_rows: int = 500_000
    bound: int = BROADCAST_ROWS


def hashed(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of strings, one after the other; null counts as nothing."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, ``-`` for null: no two rows of fields read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """``(key, lang, doc_id, leaf, changed)``: a row's hash, and what tampering makes of it (else null).

    Tampering adds 1 to ``n_chars`` of the rows whose id's crc32 7 divides.
    """
    values = {c: field(F.col(c)) for c in FIELDS}
    more = field(F.col("n_chars").cast("decimal(20,0)") + 1)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(tampered, hashed(*[more if c == "n_chars" else values[c] for c in FIELDS]))
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return docs.select(key.alias("key"), "lang", "doc_id", hashed(*values.values()).alias("leaf"), changed.alias("changed"))


def partitions_for(spark: SparkSession, rows: int, how: Manifest) -> int:
    return max(shuffle_partitions(spark), 1 + rows // how.partition_rows)


def ranked(rows: DataFrame, order: list[str], how: Manifest) -> DataFrame:
    """``rows`` with ``rank``, from 0 within ``key`` by ``order``, and ``n``, the number of rows of the key.

    ``order`` has to tell the rows of a key apart.  The rows are sorted by ranges, so
    a key may have any share of them, and stored; the number of a row in its
    partition, less that of the first one of its key there, plus the key's rows in
    earlier partitions, is its rank.
    """
    spark = rows.sparkSession
    rows = stored(rows, "merkle-leaves")
    parts = partitions_for(spark, rows.count(), how)
    by = ["key", *order]
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = stored(placed.withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("there"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "key", "part", (F.coalesce(F.sum("there").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("there").over(Window.partitionBy("key")).alias("n"),
    )
    found = checked_join(placed, stored(runs, "merkle-runs"), ["key", "part"], "inner", spread=F.xxhash64("at"), bound=how.bound)
    return found.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def rolled(rows: DataFrame, parts: int, how: Manifest) -> DataFrame:
    """``(key, block, n, tree)`` of ``(key, rank, n, hash, item)``: each block's leaves nested under its hash.

    ``tree`` has the hash and the one or two children, each a struct of the same kind;
    the innermost ones hold the leaf's ``item``.  A step above a group's height changes no hash.
    """
    digits = [F.shiftright("rank", i).bitwiseAND(1).alias(f"digit_{i}") for i in range(how.digits)]
    nodes = rows.select("key", F.shiftright("rank", how.digits).alias("block"), "n", *digits, F.struct("hash", "item").alias("node"))
    nodes = nodes.repartition(parts, "key", "block")
    for i in range(how.digits):
        above = [f"digit_{j}" for j in range(how.digits - 1, i, -1)]
        pair = [F.first(F.when(F.col(f"digit_{i}") == d, F.col("node")), ignorenulls=True).alias(f"child_{d}") for d in (0, 1)]
        grouped = nodes.groupBy("key", "block", "n", *above).agg(*pair)
        # Two runs are left at this level if the group has more leaves than one run holds.
        joint = F.when(F.col("n") > 1 << i, hashed(F.col("child_0.hash"), F.col("child_1.hash"))).otherwise(F.col("child_0.hash"))
        children = F.array_compact(F.array("child_0", "child_1"))
        nodes = grouped.select("key", "block", "n", *above, F.struct(joint.alias("hash"), children.alias("children")).alias("node"))
    return nodes.withColumnRenamed("node", "tree")


def emitted(node: Column, depth: int, n: Column, path: Column) -> Column:
    """The leaves below a node: an array of their items with their paths, the step next to the leaf first."""
    if depth == 0:
        return F.array(F.struct(node["item"].alias("item"), path.alias("path")))
    children = node["children"]

    def below(child: Column, place: Column) -> Column:
        left = F.when(place == 1, F.get(children, F.lit(0))["hash"])
        right = F.when(place == 0, F.get(children, F.lit(1))["hash"])
        step = F.when(n > 1 << (depth - 1), F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(_STEP))
        return emitted(child, depth - 1, n, F.concat(step, path))

    return F.flatten(F.transform(children, below))


class Tree:
    """The trees of groups of ``(key, rank, n, hash, item)``, in passes of bounded blocks, stored."""

    def __init__(self, rows: DataFrame, how: Manifest):
        self.how, self.passes = how, []
        count, most = rows.agg(F.count("*"), F.max("n")).first()
        most = most or 1
        while True:
            self.parts = partitions_for(rows.sparkSession, count, how)
            self.passes.append((stored(rolled(rows, self.parts, how), "merkle-trees"), self.parts))
            size = 1 << how.digits
            if most <= size:
                break
            most, count = -(-most // size), -(-count // size)
            rows = self.passes[-1][0].select(
                "key", F.col("block").alias("rank"), F.ceil(F.col("n") / size).alias("n"), F.col("tree.hash").alias("hash"), F.struct("block").alias("item")
            )

    def tops(self) -> DataFrame:
        """``(key, hash)``: the root of each group."""
        return self.passes[-1][0].select("key", F.col("tree.hash").alias("hash"))

    def paths(self, above: DataFrame) -> DataFrame:
        """``(item, path, head)`` per leaf: its path to the group's root, then that of ``above``.

        ``above`` has ``(key, path, head)``, one row per group; ``head`` is any struct
        that the group's leaves are to have.
        """
        above = above.withColumn("block", F.lit(0).cast("long"))
        for trees, parts in reversed(self.passes):
            none = [F.lit(None).cast(above.schema[c].dataType).alias(c) for c in ("path", "head")]
            both = trees.select("key", "block", "n", "tree", *none).unionByName(
                above.select("key", "block", F.lit(None).cast("long").alias("n"), F.lit(None).cast(trees.schema["tree"].dataType).alias("tree"), "path", "head")
            )
            # Two rows each: a block's tree and what lies above it.
            met = both.repartition(parts, "key", "block").groupBy("key", "block").agg(
                *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "tree", "path", "head")]
            )
            leaves = F.explode(emitted(F.col("tree"), self.how.digits, F.col("n"), F.col("path")))
            found = met.select("key", "head", leaves.alias("leaf"))
            above = found.select("key", F.col("leaf.item").alias("item"), F.col("leaf.path").alias("path"), "head")
            if trees is not self.passes[0][0]:
                above = above.select("key", F.col("item.block").alias("block"), "path", "head")
        return above


def manifest(docs: DataFrame, how: Manifest = Manifest()) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` per row.

    Leaves hash ``doc_id, source, lang, n_chars, text``; other columns are not read.
    A language's leaves ascend by ``doc_id`` (null first; equal ids by leaf hash),
    languages by their bytes, null first.  A node without a sibling is hashed alone.
    Rows that repeat are leaves of their own with the same hash.  ``folded_root`` is
    recomputed from the tampered leaf where there is one.  Texts of any length are
    hashed whole, null and empty texts differ.  An empty table gives no rows.
    """
    rows = leaves_of(docs).groupBy("key", "lang", "doc_id", "leaf", "changed").count()
    # Copies of a row are told apart by a number, so that any number of them can be spread.
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("count")
    rows = ranked(rows, ["doc_id", "leaf", "copy"], how)
    item = F.struct("lang", "doc_id", "leaf", "changed").alias("item")
    tree = Tree(rows.select("key", "rank", "n", F.col("leaf").alias("hash"), item), how)
    # "=" before a language's name, and nothing for null, keep the order of the bytes.
    tops = tree.tops().select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("hash").alias("subroot"))
    tops = ranked(tops, ["group"], how)
    whole = Tree(tops.select("key", "rank", "n", F.col("subroot").alias("hash"), F.struct("group", "subroot").alias("item")), how)
    root = whole.tops().select("key", F.array().cast(_STEP).alias("path"), F.struct(F.col("hash").alias("root")).alias("head"))
    above = whole.paths(root).select(
        F.col("item.group").alias("key"), "path", F.struct(F.col("item.subroot").alias("subroot"), F.col("head.root").alias("root")).alias("head")
    )
    found = tree.paths(above).select("item.*", "path", "head.*")
    proof = hashed(F.array_join(F.flatten(F.transform("path", lambda s: F.array_compact(F.array(s["left"], s["right"])))), ""))
    folded = F.aggregate("path", F.coalesce("changed", "leaf"), lambda node, s: hashed(s["left"], node, s["right"]))
    found = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
