"""Document fingerprints from closed syncmers.

A text is a sequence of word hashes.  Of every run of ``WORDS`` words the hashes of
its inner pairs are compared; the run is a closed syncmer if the smallest pair is
its first or its last.  That depends on nothing outside the run, so an edit changes
only the anchors that touch it, and equal passages have equal anchors at the same
distances wherever they stand.  The fingerprint is the sequence of all anchors with
their places.  Two fingerprints are compared by position: they are shifted by the
commonest distance between the anchors they share, and anchors that then lie on one
another count.

DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.llm.common import stored

WORDS = 5  # of a syncmer; its inner pairs are four
ALIGNED = 16  # shared anchors, the smallest ones, that decide by how much two sequences are shifted
_PLACE = 1 << 32


def _short(value: Column) -> Column:
    """32 bits of a hash: with a place they fit one number, and a fingerprint is no longer than it must be."""
    return value.bitwiseAND(_PLACE - 1)


def _least_first(z: Column) -> Column:
    return F.least(z["a"], z["d"]) <= F.least(z["b"], z["c"])


def with_anchors(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Add for each ``{name: text column}`` an array ``name`` of ``(at, anchor)``: the number of the word that
    the syncmer starts with, and 32 bits of its hash.

    Words are runs of other than ASCII white space.  A text of fewer than
    ``WORDS`` words has one anchor, of all its words; one without words none.  Null
    counts as empty.
    """
    other = [c for c in df.columns]
    words = {k: F.filter(F.split(F.coalesce(F.col(t), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "") for k, t in texts.items()}
    # Each step is a projection of its own: what several expressions read is computed once.
    df = df.select(*other, *(F.transform(w, lambda x: F.xxhash64(x)).alias(f"__w_{k}") for k, w in words.items()))

    def pairs(k: str) -> Column:
        w = F.col(f"__w_{k}")
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.xxhash64(x, y))

    df = df.select(*other, *(f"__w_{k}" for k in texts), *(pairs(k).alias(f"__g_{k}") for k in texts))

    def runs(k: str) -> Column:
        g = F.col(f"__g_{k}")
        n = F.greatest(F.size(g) - (WORDS - 2), F.lit(0))
        zipped = F.arrays_zip(*(F.slice(g, F.lit(i + 1), n).alias(c) for i, c in enumerate("abcd")))
        placed = F.transform(zipped, lambda z, i: F.struct(i.alias("at"), _short(F.xxhash64(z["a"], z["c"], z["d"])).alias("anchor"), _least_first(z).alias("closed")))
        kept = F.transform(F.filter(placed, lambda p: p["closed"]), lambda p: F.struct(p["at"].alias("at"), p["anchor"].alias("anchor")))
        w = F.col(f"__w_{k}")
        whole = F.struct(F.lit(0).alias("at"), _short(F.xxhash64(w)).alias("anchor"))
        return F.when(F.size(w) >= WORDS, kept).when(F.size(w) > 0, F.array(whole)).otherwise(F.array().cast("array<struct<at:int,anchor:bigint>>"))

    return df.select(*other, *(runs(k).alias(k) for k in texts))


def fingerprint(anchors: Column) -> Column:
    """The whole fingerprint, printed: ``place:anchor`` of each anchor, comma-joined; empty without words."""
    each = F.transform(anchors, lambda a: F.concat_ws(":", a["at"].cast("string"), F.lower(F.hex(a["anchor"]))))
    return F.array_join(each, ",")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once, however often a lambda reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shift(x: Column, y: Column) -> Column:
    """The commonest distance between the places of shared anchors: the first place of each of the smallest
    ``ALIGNED`` ones.  Ties: the smallest in size, then the positive one.  Null if none is shared."""

    def place(of: Column, anchor: Column) -> Column:
        return F.element_at(of, F.array_position(of["anchor"], anchor).cast("int"))["at"]

    def commonest(gaps: Column) -> Column:
        votes = F.transform(gaps, lambda g: F.struct(F.array_size(F.filter(gaps, lambda e: e == g)).alias("n"), (-F.abs(g)).alias("near"), g.alias("gap")))
        return F.array_max(votes)["gap"]

    shared = F.slice(F.sort_array(F.array_intersect(x["anchor"], y["anchor"])), 1, ALIGNED)
    return _let(F.transform(shared, lambda a: place(x, a) - place(y, a)), commonest)


def likeness(one: Column, other: Column) -> Column:
    """Share of the anchors of two fingerprints that lie on one another after the best shift, from 0 to 1.

    It is the Jaccard likeness of the two sets of (place, anchor); two empty ones are
    alike.  Text put in front shifts, text in another order does not match.
    """

    def placed(anchors: Column, back: Column | None = None) -> Column:
        at = (lambda a: a["at"]) if back is None else (lambda a: a["at"] - back)
        return F.transform(anchors, lambda a: at(a).cast("long") * _PLACE + a["anchor"])

    def measured(s: Column) -> Column:
        both = F.array_size(F.array_intersect(placed(s["x"], s["shift"]), placed(s["y"])))
        matched = F.when(s["shift"].isNull(), F.lit(0)).otherwise(both)
        either = F.array_size(s["x"]) + F.array_size(s["y"]) - matched
        return F.when(either == 0, F.lit(1.0)).otherwise(matched / F.greatest(either, F.lit(1)))

    def shifted(s: Column) -> Column:
        return _let(F.struct(s["x"].alias("x"), s["y"].alias("y"), _shift(s["x"], s["y"]).alias("shift")), measured)

    return _let(F.struct(one.alias("x"), other.alias("y")), shifted)


def with_next(docs: DataFrame, into: str = "next_text") -> DataFrame:
    """``(row, text, into)``: each row's other columns as a struct, its text (null: empty), and that of the
    next row in descending ``doc_id`` (after the last: the first).

    Rows are dealt to groups of neighbouring ids, as many as fit the shuffle
    partitions; crowded ranges of ids are cut finer.  The first row of a group also
    goes, as a guest, to the end of the group before.  So each text moves about
    once and no group holds more than its share.  Rows with equal ids are ordered
    by a hash of their text, rows without one come last.
    """
    spark = docs.sparkSession
    cuts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.col("doc_id").isNull()
    # Larger ids come first; rows without an id are placed by their text.
    value = F.when(none, F.xxhash64("text").cast("double")).otherwise(-F.col("doc_id").cast("double"))
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))  # the text moves once
    rows = docs.select(others.alias("row"), F.coalesce("text", F.lit("")).alias("text"), none.cast("int").alias("none"), value.alias("v"), "doc_id", F.xxhash64("text").alias("tid"))
    spans = stored(rows.groupBy("none").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("m")), "spans")
    total = max(1, spans.agg(F.sum("m")).first()[0] or 0)

    def cut(lo: Column, hi: Column, parts: Column | int) -> Column:
        place = F.floor((F.col("v") - lo) / F.greatest(hi - lo, F.lit(1.0)) * parts)
        return F.least(place, F.lit(parts) - 1 if isinstance(parts, int) else parts - 1).cast("int")

    rows = rows.join(F.broadcast(spans.drop("m")), "none").withColumn("coarse", cut(F.col("lo"), F.col("hi"), cuts)).drop("lo", "hi")
    share = F.ceil(F.count("*") * cuts / total)
    fine = stored(rows.groupBy("none", "coarse").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), share.alias("parts")), "ranges")
    rows = rows.join(F.broadcast(fine), ["none", "coarse"]).withColumn("fine", cut(F.col("lo"), F.col("hi"), F.col("parts"))).drop("lo", "hi", "parts")
    group = ["none", "coarse", "fine"]
    # One row per group: the first value in it, and the group before (of the first: the last).
    line = Window.orderBy(*group)
    heads = rows.groupBy(*group).agg(F.min("v").alias("head")).select(*group, "head", F.struct(*group).alias("g"))
    heads = heads.select(*group, "head", F.lag("g").over(line).alias("before"), F.last("g").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    heads = stored(heads, "heads")
    own = F.struct(*group, F.lit(0).alias("guest"))
    before = F.coalesce("before", "end")
    guest = F.struct(*(before[c].alias(c) for c in group), F.lit(1).alias("guest"))
    dealt = rows.join(F.broadcast(heads), group).select(
        "row", "text", "v", "doc_id", "tid",
        F.explode(F.when(F.col("v") == F.col("head"), F.array(own, guest)).otherwise(F.array(own))).alias("to"),
    )
    dealt = dealt.select(F.when(F.col("to.guest") == 0, F.col("row")).alias("row"), "text", "doc_id", "v", "tid", *(F.col(f"to.{c}") for c in (*group, "guest")))
    order = Window.partitionBy(*group).orderBy("guest", "v", F.col("doc_id").desc_nulls_last(), "tid")
    return dealt.withColumn(into, F.lead("text").over(order)).where("guest = 0").select("row", "text", into)


def edited_by_next(docs: DataFrame) -> DataFrame:
    """``(row, text, next_text, n_chars, edited)``: the last half of each text, in code points rounded
    down, replaced by the first as many (or all) of the next one's."""
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    return rows.select("row", "text", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited"))
