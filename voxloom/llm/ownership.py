"""Secret scan with corpus-wide ownership frequency.

Patterns give candidates with their spans.  The hash of every candidate's value is
counted over the corpus by distinct owners, repositories and texts: a value that
several owners hold, or that stands in many repositories or texts of one, is a copied
example; one that a single owner holds in few places and that does not look like a
placeholder is taken for a live credential and gets a span of its own.

DataFrame operations only.  Spans come without a matcher that reports positions:
the pieces between the matches and the matches themselves, in turn, make up the
text, so running sums of their lengths are the places.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.llm.common import salted_join, stored

# The kinds in their order, with pattern, group of the value and its least length.
KINDS = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
LIVE = "live"
_COUNTS = ("owners", "repositories", "texts")


@dataclass(frozen=True)
class Ownership:
    """Most owners, repositories and different texts of a live value, and least different characters that one has."""

    most_owners: int = 1
    most_repositories: int = 3
    most_texts: int = 10
    least_characters: int = 8


def _key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What rows that repeat share: id (with a flag for none) and a hash of the text."""
    return [
        F.col(doc_id).isNull().alias("none"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("tid"),
    ]


def _hits(order: int) -> Column:
    """The matches of a kind in ``text`` as an array of (kind, nth, gap before it, size, value), from ``hits_<order>``."""
    _, pattern, group, least = KINDS[order]
    pattern = _pattern(order)
    hits = F.col(f"hits_{order}")
    some = F.array_size(hits) > 0
    values = hits if group == 0 else F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))
    # Texts without a match, nearly all, are not split.
    gaps = F.when(some, F.transform(F.split("text", pattern, -1), lambda x: F.length(x)))
    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    placed = F.transform(
        F.filter(zipped, lambda z: z["hit"].isNotNull()),
        lambda z, i: F.struct(F.lit(order).alias("kind"), i.alias("nth"), z["gap"].alias("gap"), F.length(z["hit"]).alias("size"), z["value"].alias("value")),
    )
    return F.coalesce(placed, F.array().cast(_HITS))


def _pattern(order: int) -> str:
    """A kind's pattern; a run that is too short fails as a whole, so long runs are asked for at once where
    that is the same."""
    _, pattern, group, least = KINDS[order]
    return pattern[:-1] + f"{{{least - (4 if pattern.startswith('AKIA') else 0)},}}" if group == 0 else pattern


_HITS = "array<struct<kind: int, nth: int, gap: int, size: int, value: string>>"


def matches(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """``(none, id, tid, repository, owner, kind, nth, gap, size, value)``, one row per match of every row of
    ``docs(doc_id, text)``.  Each text is read once, and moved nowhere."""
    orders = range(len(KINDS))
    rows = docs.where(F.col("text").isNotNull()).select(
        *_key(), repository.alias("repository"), owner.alias("owner"), "text",
        *(F.regexp_extract_all("text", F.lit(_pattern(i)), F.lit(0)).alias(f"hits_{i}") for i in orders),
    )
    rows = rows.where(F.greatest(*(F.array_size(f"hits_{i}") for i in orders)) > 0)
    rows = rows.select("none", "id", "tid", "repository", "owner", F.explode(F.concat(*(_hits(i) for i in orders))).alias("at"))
    return rows.select("none", "id", "tid", "repository", "owner", "at.*")


def candidates(found: DataFrame) -> DataFrame:
    """``(none, id, tid, kind, start, end, value_start, value)`` per candidate among ``matches``; rows that
    repeat give theirs once.  Places are code points, ends exclusive."""
    once = found.drop("repository", "owner").dropDuplicates(["none", "id", "tid", "kind", "nth"])
    upto = Window.partitionBy("none", "id", "tid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = once.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    value = F.length("value")
    return rows.where(_long_enough()).select(
        "none", "id", "tid", "kind", (F.col("end") - F.col("size")).alias("start"), "end", (F.col("end") - value).alias("value_start"), "value"
    )


def _long_enough() -> Column:
    least = F.get(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("kind"))
    return F.length("value") >= least


COUNTED = {"repositories": "repository", "owners": "owner"}


def ownership(values: DataFrame, counted: dict[str, str] = COUNTED) -> DataFrame:
    """``(digest, repositories, owners)`` for ``values(digest, repository, owner)``: in how many of each a value occurs.

    ``counted`` names the counts and their columns.  Distinct pairs are made before
    they are counted, so a value that is everywhere is counted piecewise.  A null
    repository or owner is one of its own.
    """

    def distinct(name: str, of: str) -> DataFrame:
        return values.groupBy("digest", of).agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias(name))

    tables = [distinct(name, of) for name, of in counted.items()]
    return reduce(lambda a, b: a.join(b, "digest"), tables)


def scan_secrets(docs: DataFrame, repository: Column, owner: Column, how: Ownership = Ownership()) -> DataFrame:
    """``(row, n_assign, n_access, n_hex, n_live, n_copied, owners, repositories, texts, spans, base)`` per row
    of ``docs(doc_id, text, ...)``.

    ``row`` is the row as a struct.  ``base`` and ``spans`` are arrays of
    ``(start, kind, end)`` by start, then kind as listed in ``KINDS``, with live
    values after them; ``spans`` holds both.  ``n_copied`` counts candidates whose
    value more owners, repositories or texts hold than ``how`` allows a live one;
    ``owners``, ``repositories`` and ``texts`` are the most that hold one value of the
    row, 0 without candidates.

    Null and empty texts have no spans.  Rows that repeat (equal id and text) are
    one text whose owners are those of all of them; so are rows without an id and
    with equal text.  Very long texts are scanned whole.  An empty table gives no
    rows.  Other columns are in ``row`` untouched, whatever their names.
    """
    found = stored(matches(docs, repository, owner), "secret-matches")
    digest = F.sha2("value", 256).alias("digest")
    key = ["none", "id", "tid"]
    values = found.where(_long_enough()).select("tid", digest, "repository", "owner").distinct()
    owners = stored(ownership(stored(values, "secret-values"), COUNTED | {"texts": "tid"}), "ownership")
    judged = salted_join(candidates(found).withColumn("digest", digest), owners, "digest", "inner", spread=F.xxhash64(*key), salts=8)
    few = (F.col("owners") <= how.most_owners) & (F.col("repositories") <= how.most_repositories) & (F.col("texts") <= how.most_texts)
    varied = F.array_size(F.array_distinct(F.split("value", ""))) >= how.least_characters
    judged = judged.withColumns({"few": few, "live": few & varied})
    base = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    extra = F.struct(F.col("value_start").alias("start"), F.lit(len(KINDS)).alias("kind"), F.col("end"))
    counts = [F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{name}") for i, (name, *_) in enumerate(KINDS)]
    per_text = judged.groupBy(*key).agg(
        *counts,
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("few"), 1)).alias("n_copied"),
        *[F.max(c).alias(c) for c in _COUNTS],
        F.sort_array(F.collect_list(base)).alias("base"),
        F.collect_set(F.when(F.col("live"), extra)).alias("extra"),
    )
    per_text = per_text.withColumn("spans", F.sort_array(F.concat("base", "extra"))).drop("extra")
    rows = docs.select(F.struct("*").alias("row"), *_key(), F.xxhash64(F.monotonically_increasing_id()).alias("spread"))
    both = salted_join(rows, per_text, key, "left", spread=F.col("spread"), salts=4)
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in (*(f"n_{k[0]}" for k in KINDS), "n_live", "n_copied", *_COUNTS)]
    lists = [F.coalesce(c, F.array().cast(per_text.schema[c].dataType)).alias(c) for c in ("spans", "base")]
    return both.select("row", *numbers, *lists)


def printed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit(LIVE))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
