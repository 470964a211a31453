"""Subsamples, shuffles, shards and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog.fixtures import table
from voxloom.catalog.registry import register
from voxloom.operators import batching, sampling
from voxloom.operators.rows import categorical_filter, union_sources
from voxloom.sources.readers import with_sample_index

SAMPLE_SIZES = {"en": 150, "fr": 40, "de": 1_000_000}


@register(
    "subsample_max_len",
    " UNION ALL ".join(
        f"""(SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE lang = '{lang}'
             ORDER BY md5('42:' || doc_id), doc_id LIMIT {n})"""
        for lang, n in SAMPLE_SIZES.items()
    ),
)
def subsample_max_len(spark, sf):
    """One source per language, each with its own max_len; the last asks for more rows than it has."""
    docs = table(spark, sf, "documents")
    return union_sources(
        [
            sampling.subsample(categorical_filter(docs, "lang", lang), n, key=["doc_id"])
            for lang, n in SAMPLE_SIZES.items()
        ]
    ).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@register(
    "subsample_equal_keys",
    "SELECT CAST(least(count(*), 50) AS BIGINT) AS n, CAST(least(count(*), 50) AS BIGINT) AS distinct_rows FROM documents",
)
def subsample_equal_keys(spark, sf):
    """Keys that many rows share, some of them null: the sample is exact all the same."""
    docs = table(spark, sf, "documents").withColumn("kind", F.when(F.col("lang") != "fr", F.col("lang")))
    taken = sampling.subsample(docs, 50, key=["kind"])
    return taken.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("distinct_rows"))


@register(
    "assign_batches_equal_keys",
    """
    WITH counted AS (SELECT doc_id, count(*) OVER () AS n FROM documents)
    SELECT doc_id, n, (n + 7) // 8 AS n_batches, (n + 7) // 8 - 1 AS last_batch, n - n % 8 AS in_full_batches FROM counted
    """,
)
def assign_batches_equal_keys(spark, sf):
    """Batches over keys that many rows share: every row in one, numbered without gaps, full but for the last."""
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") != "fr", F.col("lang")).alias("kind"))
    out = batching.assign_batches(docs, key=["kind"], batch_size=8, unique=False)
    per_batch = out.groupBy("batch_id").agg(F.count("*").alias("rows"))
    whole = per_batch.agg(
        F.sum("rows").alias("n"),
        F.count("*").alias("n_batches"),
        F.max("batch_id").alias("last_batch"),
        F.coalesce(F.sum(F.when(F.col("rows") == 8, F.col("rows"))), F.lit(0)).alias("in_full_batches"),
    )
    return out.select("doc_id").crossJoin(F.broadcast(whole))  # one row


@register(
    "global_shuffle",
    "SELECT doc_id, md5('42:' || doc_id) AS position, md5(text) AS text_md5 FROM documents ORDER BY position, doc_id",
)
def global_shuffle(spark, sf):
    shuffled = sampling.global_shuffle(table(spark, sf, "documents"), key=["doc_id"])
    position = F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))
    return shuffled.select("doc_id", position.alias("position"), F.md5("text").alias("text_md5"))


@register(
    "shard",
    """SELECT doc_id, CAST(CAST('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4 AS INT)
         AS shard FROM documents""",
)
def shard(spark, sf):
    return sampling.shard(table(spark, sf, "documents"), 4, key=["doc_id"]).select("doc_id", "shard")


@register(
    "shard_ranges",
    "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INT) AS shard FROM documents",
)
def shard_ranges(spark, sf):
    """Seven consecutive runs of the stored rows, which lie in doc_id order."""
    rows = with_sample_index(table(spark, sf, "documents"))
    return sampling.shard_ranges(rows, 7, index="sample_index").select("doc_id", "shard")


@register("sample_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS sample_index FROM documents")
def sample_index(spark, sf):
    return with_sample_index(table(spark, sf, "documents")).select("doc_id", "sample_index")


@register(
    "ordered_restore",
    """
    SELECT source_idx, doc_id, shard, text_md5 FROM (
      SELECT CASE lang WHEN 'en' THEN 0 ELSE 1 END AS source_idx, doc_id, md5(text) AS text_md5,
        CAST(CAST('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4 AS INT) AS shard
      FROM documents)
    ORDER BY source_idx, shard, doc_id
    """,
)
def ordered_restore(spark, sf):
    docs = table(spark, sf, "documents").withColumn(
        "source_idx", F.when(F.col("lang") == "en", F.lit(0)).otherwise(F.lit(1))
    )
    sharded = sampling.shard(docs, 4, key=["doc_id"])
    rows = sharded.select("source_idx", "doc_id", "shard", F.md5("text").alias("text_md5"))
    return sampling.ordered_restore(rows, order=["source_idx", "shard", "doc_id"])
