"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of ``block`` words are handed out in the order of golden-ratio points: point
``k`` falls into one source's part of the cumulated targets, and the n-th slot of a
source takes the n-th block of its word stream.  The stream is the source's
documents one after the other in the order of a hash, over and over again, so its
blocks are shuffled and equally long.  Any run of slots holds the sources close to
their shares.

A document's words are an interval of its source's stream: sums over hash buckets say
where a bucket begins, and the place inside the bucket does the rest.  The intervals
of all rounds meet the slots by the number of the block, which gives the mixed stream
of ``(slot, document, span)``; what the mix takes of a document is the sum of its
spans.  Nothing but sizes moves for that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.llm.common import BROADCAST_ROWS, checked_join, stored

# 2**32 divided by the golden ratio, made odd: its multiples modulo 2**32 are the points.
GOLDEN = 2654435769
POINTS = 1 << 32
CELLS = 1024
# The owner of the slots that small sources share.
POOL = -1


@dataclass(frozen=True)
class Mix:
    """Weights, repeating, of the sources in the order of their names; how often a word may be
    taken; least words of a slot and most slots (a larger corpus has longer slots); hash
    buckets of a stream, a power of two."""

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    least_block: int = 64
    most_slots: int = 1 << 22
    buckets: int = 4096


def words(text: str = "text") -> Column:
    """Runs of other than ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _named(source: str = "source") -> list[Column]:
    """A source's name as two columns that join: a null name is its own source."""
    return [F.col(source).isNull().alias("unnamed"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name")]


def _place(buckets: int) -> list[Column]:
    """Where a document stands in its source's stream: 60 bits of a hash, in buckets of its leading bits."""
    text = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text")))
    h = F.conv(F.substring(text, 1, 15), 16, 10).cast("long")
    bits = buckets.bit_length() - 1
    return [h.alias("h"), F.shiftright(h, 60 - bits).cast("int").alias("bucket")]


def targets(sizes: DataFrame, how: Mix) -> DataFrame:
    """``(unnamed, name, sid, source_size, target)`` per source.

    The targets share all words by weight; one that exceeds ``most`` times its
    source's size stops there, and the rest is shared again.  In the order of
    size by weight the sources that stop come first, so running sums find them.
    """
    names = sizes.groupBy("unnamed", "name").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("unnamed", "name")
    weight = F.element_at(F.lit(list(how.weights)), (F.pmod(F.col("sid"), F.lit(len(how.weights))) + 1).cast("int"))
    named = names.select("*", (F.row_number().over(order) - 1).cast("long").alias("sid"))
    named = named.select("*", weight.cast("double").alias("w"), (how.most * F.col("source_size")).cast("double").alias("cap"))
    by_need = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    on = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    run = named.select("*", (F.col("cap") * F.sum("w").over(on) <= F.col("w") * left).alias("stops"))
    free = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(every), F.lit(0.0))
    share = F.col("w") * free / F.sum(F.when(~F.col("stops"), F.col("w"))).over(every)
    target = F.when(F.col("stops"), F.col("cap")).otherwise(share)
    return run.select("unnamed", "name", "sid", "source_size", target.alias("target"))


def schedule(sources: DataFrame, how: Mix) -> DataFrame:
    """``(slot, sid, nth, first_word)``: the slots in order, whose they are, and where in the source's
    endless stream the slot's block of ``block`` words begins; the pool of small sources is ``POOL``."""
    total = int(sources.agg(F.sum("source_size")).first()[0] or 0)
    block, slots = slot_size(total, how)
    owners = sources.groupBy(_owner(block).alias("sid")).agg(F.sum("target").alias("target"))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = owners.select("sid", F.least(F.floor(F.sum("target").over(upto) / F.lit(max(total, 1)) * POINTS), F.lit(POINTS)).alias("hi"))
    parts = ends.select("sid", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0)).alias("lo"), "hi").where("lo < hi")
    width = POINTS // CELLS
    cells = parts.select("*", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    spark = sources.sparkSession
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * GOLDEN, F.lit(POINTS)).alias("u"))
    points = points.select("*", F.floor(F.col("u") / width).alias("cell"))
    owned = points.join(cells, "cell").where("lo <= u and u < hi").select("slot", "sid", F.shiftright("slot", 16).alias("run"))
    # The place of a slot among its source's: per run of 65,536 slots, then inside the run.
    runs = owned.groupBy("sid", "run").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("sid", "run", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("skip"))
    inside = F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1
    nth = (F.col("skip") + F.col("inside")).alias("nth")
    return (
        owned.select("*", inside.alias("inside"))
        .join(runs, ["sid", "run"])
        .select("slot", "sid", nth)
        .select("*", (F.col("nth") * block).alias("first_word"))
    )


def _owner(block: int) -> Column:
    """Whose slots a source's words are in: its own, or the pool's.

    Golden-ratio points leave no gap of two slots, so whoever has two blocks has a slot.
    """
    return F.when(F.col("target") < 2 * block, F.lit(POOL)).otherwise(F.col("sid")).cast("long")


def slot_size(total: int, how: Mix) -> tuple[int, int]:
    """Words of a slot, and number of slots that hold ``total`` words."""
    block = max(how.least_block, -(-total // how.most_slots))
    return block, -(-total // block)


def _rows(docs: DataFrame, how: Mix) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), *_named(), *_place(how.buckets), words().alias("size"))


def _pieces(rows: DataFrame, how: Mix) -> tuple[DataFrame, DataFrame]:
    """The mixed stream, ``(slot, unnamed, name, h, size, m, doc_id, round, a, begin, end)``, and the sources.

    A row is the words from ``begin`` to ``end`` of a source's endless stream, which
    lie in one slot and belong to the ``m`` equal documents whose words of that
    round begin at ``a``.
    """
    sizes = stored(rows.select("unnamed", "name", "bucket", "h", "size", F.col("row.doc_id").alias("doc_id")), "sizes")
    sources = stored(targets(sizes, how), "sources")
    total = int(sources.agg(F.sum("source_size")).first()[0] or 0)
    block, slots = slot_size(total, how)
    slot = stored(schedule(sources, how), "schedule")
    mine = slot.groupBy(F.col("sid").alias("owner")).agg(F.count("*").alias("n"))
    # Every source ends at the nearest word to its target; the pool's follow one another.
    aims = sources.select("*", _owner(block).alias("owner"), F.floor(F.col("target") + 0.5).alias("words")).where("words > 0")
    earlier = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    pool = aims.where(F.col("owner") == POOL).select("*", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    pooled = int(pool.agg(F.sum("words")).first()[0] or 0)
    own = aims.where(F.col("owner") != POOL).select("*", F.lit(0).cast("long").alias("base"))
    known = pool.unionByName(own).join(mine, "owner", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    # A pool without a slot gets one behind all others.
    behind = sources.sparkSession.range(1).select(F.lit(slots).cast("long").alias("slot"), F.lit(POOL).cast("long").alias("sid"), F.lit(0).cast("long").alias("nth"))
    places = slot.select("slot", "sid", "nth")
    if pooled and slot.where(F.col("sid") == POOL).isEmpty():
        places = places.unionByName(behind)
    length = F.when(F.col("owner") == POOL, F.expr(f"({pooled} + n - 1) div n")).otherwise(F.lit(block))
    ends = known.select(
        "unnamed", "name", "source_size", "words", F.col("owner").alias("sid"), "base", length.cast("long").alias("block"),
        (F.col("n") - 1).alias("last"),
    )
    ends = stored(ends, "ends")

    # Where a document's words begin: its bucket, then its place inside the bucket; equal ones are one interval.
    sums = sizes.groupBy("unnamed", "name", "bucket").agg(F.sum("size").alias("words_in"))
    earlier = Window.partitionBy("unnamed", "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("unnamed", "name", "bucket", F.coalesce(F.sum("words_in").over(earlier), F.lit(0)).alias("start"))
    same = sizes.where("size > 0").groupBy("unnamed", "name", "bucket", "h", "size")
    same = same.agg(F.count("*").alias("m"), F.max("doc_id").alias("doc_id"))
    before = Window.partitionBy("unnamed", "name", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("m") * F.col("size")).over(before), F.lit(0))
    placed = same.select("*", inside.alias("inside")).join(starts, ["unnamed", "name", "bucket"])
    placed = checked_join(placed, ends, ["unnamed", "name"], "inner", spread=F.col("h"))

    # Its interval in every round up to the stream's end, cut at the blocks, meets the slots.
    rounds = placed.select("*", F.explode(F.expr("sequence(0L, (words - 1) div source_size)")).alias("round"))
    rounds = rounds.select("*", (F.col("round") * F.col("source_size") + F.col("start") + F.col("inside")).alias("a"))
    rounds = rounds.select("*", F.least(F.col("a") + F.col("m") * F.col("size"), F.col("words")).alias("b")).where("a < b")
    numbers = "sequence(least((base + a) div block, last), least((base + b - 1) div block, last))"
    cut = rounds.select("*", F.explode(F.expr(numbers)).alias("nth"))
    first = F.col("nth") * F.col("block") - F.col("base")
    upto = F.when(F.col("nth") == F.col("last"), F.col("b")).otherwise(F.least("b", first + F.col("block")))
    met = cut.join(places, ["sid", "nth"]).select(
        "slot", "unnamed", "name", "h", "size", "m", "doc_id", "round", "a", F.greatest("a", first).alias("begin"), upto.alias("end")
    )
    return stored(met, "mixed"), sources


def mixed(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """``(slot, place, doc_id, source, round, copy, first, last)``: the mixed stream of ``docs(doc_id, text, source)``.

    A row says that the slot holds the document's words from number ``first`` up to
    ``last``, exclusively; ordered by slot, source and place (the number of the word in
    its source's endless stream) the rows are the whole mix.  ``round`` counts how
    often the source's stream was gone through before, ``copy`` tells rows that
    repeat apart.  A null source stays null; documents without words are in no slot.
    """
    found, _ = _pieces(_rows(docs, how), how)
    copies = F.explode(F.expr("sequence((begin - a) div size, (end - a - 1) div size)"))
    each = found.select("*", copies.alias("copy")).select("*", (F.col("a") + F.col("copy") * F.col("size")).alias("at"))
    begin, end = F.greatest("begin", "at"), F.least("end", F.col("at") + F.col("size"))
    return each.select(
        "slot", begin.alias("place"), "doc_id", F.when(~F.col("unnamed"), F.col("name")).alias("source"), "round", "copy",
        (begin - F.col("at")).alias("first"), (end - F.col("at")).alias("last"),
    )


def mix(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """``(row, size, source_size, target, taken, rounds)`` per row of ``docs(doc_id, text, source, ...)``.

    ``row`` is the row as it was, as a struct; ``taken`` counts the words that the
    mix takes of it, repeats included.  ``rounds`` has, for every round of the
    source's stream in which the mix reaches it, ``(round, slot, words)``: the slot
    of its first word and how many words are taken.

    Null text has no words, and takes none.  A null source is a source, after all
    others.  Rows without an id are placed by their text; rows that repeat share a
    place in the stream and take the same.  Sources without words, and tables
    without any, have a target of 0.  An empty table gives no rows.  Other columns
    are in ``row`` untouched, whatever their names.
    """
    rows = _rows(docs, how)
    found, sources = _pieces(rows, how)
    keys = ["unnamed", "name", "h", "size"]
    each = found.groupBy(*keys, "m", "round").agg(F.sum(F.col("end") - F.col("begin")).alias("words"), F.min_by("slot", "begin").alias("slot"))
    part = F.struct("round", "slot", F.expr("words div m").alias("words"))
    spans = each.groupBy(*keys, "m").agg(F.expr("sum(words) div m").alias("taken"), F.sort_array(F.collect_list(part)).alias("rounds"))
    spans = stored(spans, "spans")

    known = sources.select("unnamed", "name", "source_size", "target")
    whole = checked_join(rows, known, ["unnamed", "name"], "left", spread=F.col("h"))
    both = _with_spans(whole, spans, keys)
    none = F.lit([]).cast(spans.schema["rounds"].dataType)
    taken, rounds = F.coalesce("taken", F.lit(0)).cast("long"), F.coalesce("rounds", none)
    return both.select("row", "size", "source_size", "target", taken.alias("taken"), rounds.alias("rounds"))


def _with_spans(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` with a stored table of one row per document: broadcast while it is small,
    else shuffled, but for documents that have at least one in 1,000 of the rows."""
    count, weight = spans.agg(F.count("*"), F.sum("m")).first()
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(spans.drop("m")), keys, "left")
    often = F.col("m") * 1000 >= weight
    hot = spans.where(often).select(*keys, F.col("taken").alias("hot_taken"), F.col("rounds").alias("hot_rounds"))
    cold = spans.where(~often).drop("m")
    # Rows that have theirs go anywhere: a place is never negative.
    anywhere = -1 - F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))
    left = rows.join(F.broadcast(hot), keys, "left")
    left = left.withColumn("h", F.when(F.col("hot_taken").isNotNull(), anywhere).otherwise(F.col("h")))
    both = left.join(cold.hint("merge"), keys, "left")
    return both.withColumns({c: F.coalesce(f"hot_{c}", c) for c in ("taken", "rounds")}).drop("hot_taken", "hot_rounds")
