"""From raw documents to piece ids: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import pick_rows, read, stored
from voxloom.llm.jaccard import JaccardJoin, jaccard_classes
from voxloom.llm.mixing import Mix, mix
from voxloom.llm.pieces import Dropout, Pieces, encode
from voxloom.llm.queries import PIECE_MODEL
from voxloom.llm.templates import drop_recurring_lines
from voxloom.llm.toxicity import fit_toxicity, score_toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learned from ``labels.toxic``, stays below one half."""
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("score < 0.5").select("row.*")


def remove_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that earlier documents have; a document that loses its whole text goes."""
    rows = drop_recurring_lines(docs).where((F.col("n_dropped") == 0) | (F.col("text") != ""))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.length("text"))}
    # A document that lost nothing stays as it was, whatever its n_chars says.
    return rows.select(*(new[c].cast(t).alias(c) if c in new else F.col(f"row.`{c}`") for c, t in docs.dtypes))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Five-word shingles, similarity of 0.8 or more.  Rows that repeat count once;
    rows without an id stay, once per text; texts without words stay.
    """
    found = jaccard_classes(docs, JaccardJoin(words=5, percent=80))
    found = stored(found.where("n_shingles > 0").select("doc_id", "component_id"), "near-duplicates")
    later = found.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    later = later.withColumn("is_later", F.lit(True))
    often = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("gone")).count().where("count > 1")
    marks = later.join(often.select("gone", F.lit(True).alias("is_often")), "gone", "full_outer")
    marks = stored(marks, "marks")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("tid"))
    # Rows without an id have no marks; joined, they would all meet in one task.
    both = pick_rows(rows.where("doc_id is not null"), marks, F.col("doc_id") == F.col("gone"), how="left").where("is_later is null")
    again = F.col("is_often").isNotNull()
    lost = rows.where("doc_id is null")
    once = both.where(again).select(*rows.columns).unionByName(lost).dropDuplicates(["doc_id", "tid"]).select("row")
    return both.where(~again).select("row").unionByName(once).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole copy, in the order of the slots in
    which the copies begin; documents without words have nothing to mix and stay once, at the end."""
    rows = mix(docs, Mix()).select("row", "size", F.expr("filter(rounds, r -> 2 * r.words >= size).slot").alias("slots"))
    rows = rows.select("row", F.when(F.col("size") == 0, F.array(F.lit(None).cast("long"))).otherwise(F.col("slots")).alias("slots"))
    rows = rows.select("row", F.explode("slots").alias("slot"))
    # Beside the slot something to part the rows that have none.
    return rows.orderBy(F.col("slot").asc_nulls_last(), F.xxhash64("row.doc_id", "row.text")).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, ids)``: the piece ids of every text, with merge-dropout."""
    docs = docs.select("doc_id", "source", "text")
    rows = encode(docs, Pieces(PIECE_MODEL), Dropout(), F.xxhash64("doc_id", "text"))
    return rows.select("row.doc_id", "row.source", "ids")


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_recurring_lines),
    ("near_duplicates", remove_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each is stored before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
