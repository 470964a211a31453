"""Line dedup with a log-template tree.

Lines are parsed to a fixed depth: a leaf is the number of tokens and the first
``depth`` tokens, after fields that hold digits became ``<*>``.  In a leaf that
many documents reach, a token is constant at its place if enough documents agree
on it there, else it is generalised to ``<*>`` too; a line with too few constants
has no template beyond itself.  A line goes from every document but the first if
its masked form, or its template, recurs across documents.  A line with too few
constants beside its masked fields counts as it is, and so does a line of few tokens,
which must recur in as many documents as a template.

The tree is a table: leaves, tokens and templates are counted by Spark, so it does
not depend on the order of lines and grows with the number of tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from voxloom.llm.common import blocks, heat_join, map_arrow, perhaps_in, salted_join, stored

VARIABLE = "<*>"
SHORT = 0
BLOCK_BYTES = 2_000_000
_DIGIT = re.compile("[0-9]")


@dataclass(frozen=True)
class TemplateTree:
    """Leading tokens of a leaf; least tokens of a line that is masked, may have a template and
    goes from ``min_docs`` on; documents that make a line, and a template or a shorter line,
    recur; least percentage of constants in a template and in a masked line."""

    depth: int = 3
    min_tokens: int = 6
    min_docs: int = 2
    min_template_docs: int = 5
    constant_percent: int = 70


def line_tokens(line: str) -> list[str]:
    """Tokens between white space; those that hold a digit become a variable."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
    return tokens


_LINES = "id long, tid long, pos int, leaf long, e1 long, e2 long"


def _parse(batch: pa.RecordBatch, how: TemplateTree) -> Iterator[pa.RecordBatch]:
    """A row per line that is not blank: its document, place, leaf and the hash of the form that counts,
    which is masked where enough stays constant.  Lines of few tokens count as they are, with the leaf ``SHORT``."""
    import numpy as np
    import xxhash

    for part in blocks(batch, "text", BLOCK_BYTES):
        owns, at, hashes = [], [], []
        for own, text in enumerate(part.column("text")):
            for pos, line in enumerate(text.as_py().split("\n")):
                tokens = line_tokens(line)
                if not tokens:
                    continue
                short = len(tokens) < how.min_tokens
                if short or (len(tokens) - tokens.count(VARIABLE)) * 100 < len(tokens) * how.constant_percent:
                    whole = "\n".join(line.split())  # no masked form has a line end
                else:
                    whole = " ".join(tokens)
                head = f"{len(tokens)} {' '.join(tokens[: how.depth])}"
                leaf = bytes(8) if short else xxhash.xxh3_64_digest(head.encode("utf-8", "surrogatepass"))
                owns.append(own)
                at.append(pos)
                hashes.append(leaf + xxhash.xxh3_128_digest(whole.encode("utf-8", "surrogatepass")))
        numbers = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 3)
        whose = pa.array(owns, pa.int32())
        columns = [part.column("id").take(whose), part.column("tid").take(whose), pa.array(at, pa.int32())]
        columns += [pa.array(numbers[:, k]) for k in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "tid", "pos", "leaf", "e1", "e2"])


@F.pandas_udf(ArrayType(StringType()))
def _shown(lines: pd.Series) -> pd.Series:
    return lines.map(line_tokens)


def _doc_key() -> Column:
    """What tells documents apart and orders them: ids first, rows without one last, then the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tid"))


def recurring_lines(docs: DataFrame, how: TemplateTree = TemplateTree()) -> DataFrame:
    """``(doc, drops)`` per document that loses lines: its key and the positions of the lines."""
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tid"), "text")
    doc = F.struct(F.col("id").isNull().alias("none"), "id", "tid").alias("doc")
    lines = stored(
        map_arrow(texts, lambda batch: _parse(batch, how), _LINES).select(doc, "pos", "leaf", "e1", "e2"), "lines"
    )
    line = ["leaf", "e1", "e2"]
    per_doc = lines.groupBy(*line, "doc").agg(F.min("pos").alias("pos"), F.count("*").alias("m"))
    exact = per_doc.groupBy(*line).agg(
        F.count("*").alias("docs"), F.sum("m").alias("lines"), F.min(F.struct("doc", "pos")).alias("at")
    )
    exact = stored(exact, "exact")
    long = exact.where(F.col("leaf") != SHORT)

    # Leaves that several different lines of enough documents reach.
    leaves = long.groupBy("leaf").agg(F.sum("docs").alias("all"), F.count("*").alias("kinds"))
    leaves = leaves.where((F.col("all") >= how.min_template_docs) & (F.col("kinds") > 1)).select("leaf")
    open_lines = salted_join(long, leaves, "leaf", "left_semi", spread=F.col("e1"), salts=8, merge=True)
    wanted = stored(
        open_lines.select(*line, "docs", F.xxhash64("at.doc").alias("at"), F.col("at.pos").alias("at_pos")), "wanted"
    )
    # Only documents that may show a line are split; the wanted lines, which grow with the corpus, are never broadcast.
    showing = perhaps_in(texts.select(doc, "text"), F.xxhash64("doc"), wanted, "at")
    split = showing.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    here = (F.xxhash64("doc") == F.col("at")) & (F.col("pos") == F.col("at_pos"))
    # Rows that repeat show their lines again: one counts.
    shown = split.join(wanted.hint("merge"), here).select(*line, "docs", _shown("line").alias("toks")).dropDuplicates(line)
    fields = stored(shown.select(*line, "docs", F.posexplode("toks").alias("i", "tok")), "fields")
    place = ["leaf", "i", "tok"]
    constants = (
        fields.groupBy(*place).agg(F.sum("docs").alias("m")).where(F.col("m") >= how.min_template_docs).drop("m")
    )
    marked = salted_join(
        fields.where(F.col("tok") != VARIABLE), constants, place, "inner", spread=F.col("e1"), salts=8, merge=True
    )
    known = marked.groupBy(*line).agg(F.sort_array(F.collect_list(F.struct("i", "tok"))).alias("kept"))
    lengths = fields.groupBy(*line).agg(F.count("*").alias("n"))
    template = (
        known.join(lengths, line)
        .where(F.size("kept") * 100 >= F.col("n") * how.constant_percent)
        .select(*line, F.xxhash64("leaf", "kept").alias("t1"), F.hash("kept").alias("t2"))
    )
    template = stored(template, "templates")
    members = salted_join(per_doc, template, line, "inner", spread=F.xxhash64("doc"), merge=True)
    by_doc = members.select("t1", "t2", "doc").distinct()
    spread_out = (
        by_doc.groupBy("t1", "t2")
        .agg(F.count("*").alias("m"), F.min("doc").alias("first"))
        .where(F.col("m") >= how.min_template_docs)
    )
    general = salted_join(template, spread_out.drop("m"), ["t1", "t2"], "inner", spread=F.col("e1"), salts=8, merge=True)
    general = general.select(*line, F.col("first").alias("first_t"))

    enough = F.when(F.col("leaf") == SHORT, how.min_template_docs).otherwise(how.min_docs)
    firsts = exact.where(F.col("docs") >= enough).select(*line, "lines", F.col("at.doc").alias("first_e"))
    recurring = firsts.join(general, line, "full_outer").withColumn("lines", F.coalesce("lines", F.lit(1)))
    recurring = stored(recurring, "recurring")
    hits = heat_join(lines, recurring, line, weight="lines", total=exact.agg(F.sum("lines")).first()[0] or 0)
    # Null-safe: rows without an id have a null in their key.
    differs = [~F.col("doc").eqNullSafe(F.col(c)) & F.col(c).isNotNull() for c in ("first_e", "first_t")]
    return hits.where(differs[0] | differs[1]).groupBy("doc").agg(F.collect_set("pos").alias("drops"))


def drop_recurring_lines(docs: DataFrame, how: TemplateTree = TemplateTree()) -> DataFrame:
    """``(row, text, n_lines, n_dropped)`` per row: its other columns as a struct, and its remaining text.

    The document with the smallest id keeps a recurring line, all later ones lose
    it; inside one document a line may repeat.  Lines of fewer than ``min_tokens``
    tokens go if they are the same, but for white space, in ``min_template_docs``
    documents; blank lines, null and empty texts stay.  Rows with equal id and text
    are one document and keep the same lines; rows without an id come after all
    others and are told apart by their text.  Ties cannot occur: keys are distinct.
    An empty table gives an empty result.  Other columns, whatever their names, are
    in ``row`` untouched.
    """
    drops = recurring_lines(docs, how)
    # The text moves once: ``row`` is without it.
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = docs.select(others.alias("row"), _doc_key().alias("doc"), F.col("text").alias("body"))
    rows = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    left = rows.select("row", "body", "spread", F.col("doc.none"), F.coalesce("doc.id", F.lit(0)).alias("id"), F.col("doc.tid"))
    right = drops.select("drops", F.col("doc.none"), F.coalesce("doc.id", F.lit(0)).alias("id"), F.col("doc.tid"))
    both = salted_join(left, right, ["none", "id", "tid"], "left", spread=F.col("spread"), salts=4, merge=True)
    # The lambda's argument holds both arrays, so each is made once per row.
    kept = F.expr(
        """array_join(element_at(transform(
             array(named_struct('l', lines, 'k', array_except(sequence(0, size(lines) - 1), drops))),
             s -> transform(s.k, i -> s.l[i])), 1), '\n')"""
    )
    both = both.withColumn("lines", F.split("body", "\n", -1))
    return both.select(
        "row",
        F.when(F.col("drops").isNull(), F.col("body")).otherwise(kept).alias("text"),
        F.coalesce(F.array_size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.array_size("drops"), F.lit(0)).alias("n_dropped"),
    )
