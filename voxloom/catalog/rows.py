"""Filters, renames, text and speaker columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog.fixtures import documents, table
from voxloom.catalog.registry import register
from voxloom.functions.text import speaker_prompt as prompt_of
from voxloom.functions.text import text_preview as preview_of
from voxloom.operators import rows


@register("categorical_filter", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE lang = 'en'")
def categorical_filter(spark, sf):
    kept = rows.categorical_filter(table(spark, sf, "documents"), "lang", "en")
    return kept.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@register(
    "rename_columns",
    "SELECT conv_id AS sample, turn AS position, role AS speaker, text AS sentence FROM conversations",
)
def rename_columns(spark, sf):
    names = {"conv_id": "sample", "turn": "position", "role": "speaker", "text": "sentence"}
    return rows.rename_columns(table(spark, sf, "conversations"), names)


@register(
    "resolve_speaker",
    """
    SELECT doc_id, 'alice' AS fixed_speaker,
           CASE WHEN lang <> 'es' THEN source END AS column_speaker,
           'anon' AS missing_speaker,
           'alice' AS fixed_over_column
    FROM documents
    """,
)
def resolve_speaker(spark, sf):
    df = documents(spark, sf)
    df = rows.resolve_speaker(df, speaker_id="alice", into="fixed_speaker")
    df = rows.resolve_speaker(df, speaker_column="speaker", into="column_speaker")
    df = rows.resolve_speaker(df, speaker_column="no_such_column", into="missing_speaker")
    df = rows.resolve_speaker(df, speaker_column="speaker", speaker_id="alice", into="fixed_over_column")
    return df.select("doc_id", "fixed_speaker", "column_speaker", "missing_speaker", "fixed_over_column")


@register(
    "eval_speaker",
    """
    SELECT doc_id, 'alice' AS fixed_speaker,
           CASE WHEN lang <> 'es' THEN source END AS column_speaker,
           CAST(NULL AS VARCHAR) AS missing_speaker
    FROM documents
    """,
)
def eval_speaker(spark, sf):
    df = documents(spark, sf)
    df = rows.eval_speaker(df, speaker_id="alice", into="fixed_speaker")
    df = rows.eval_speaker(df, speaker_column="speaker", into="column_speaker")
    df = rows.eval_speaker(df, speaker_column="no_such_column", into="missing_speaker")
    return df.select("doc_id", "fixed_speaker", "column_speaker", "missing_speaker")


@register(
    "attach_text",
    "SELECT conv_id, turn, text AS found_text, '' AS missing_text FROM conversations",
)
def attach_text(spark, sf):
    df = rows.attach_text(table(spark, sf, "conversations"), text_column="text", into="found_text")
    df = rows.attach_text(df, text_column="sentence", into="missing_text")
    return df.select("conv_id", "turn", "found_text", "missing_text")


@register(
    "speaker_prompt",
    """
    SELECT doc_id,
           md5(CASE WHEN lang <> 'es' THEN lower(upper(source)) || ': ' || text ELSE text END) AS row_prompt,
           md5('robin: ' || text) AS fixed_prompt,
           md5(text) AS bare_prompt
    FROM documents
    """,
)
def speaker_prompt(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        F.md5(prompt_of("text", F.upper("speaker"))).alias("row_prompt"),
        F.md5(prompt_of("text", F.col("speaker"), "Robin")).alias("fixed_prompt"),
        F.md5(prompt_of("text")).alias("bare_prompt"),
    )


@register(
    "skip_empty_text",
    """
    SELECT doc_id, md5(transcript) AS transcript_md5
    FROM (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text END AS transcript
          FROM documents)
    WHERE transcript IS NOT NULL AND transcript <> ''
    """,
)
def skip_empty_text(spark, sf):
    kind = F.col("doc_id") % 10
    transcript = F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit("")).otherwise(F.col("text"))
    df = documents(spark, sf).withColumn("transcript", transcript)
    return rows.skip_empty_text(df, "transcript").select("doc_id", F.md5("transcript").alias("transcript_md5"))


@register("text_preview", "SELECT doc_id, substring(text, 1, 100) AS preview FROM documents")
def text_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", preview_of("text").alias("preview"))


@register(
    "union_sources",
    """
    SELECT 'documents' AS dataset, CAST(doc_id AS VARCHAR) AS row_key, md5(text) AS text_md5, lang
    FROM documents
    UNION ALL
    SELECT 'conversations', conv_id || '/' || turn, md5(text), NULL FROM conversations
    """,
)
def union_sources(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.lit("documents").alias("dataset"), F.col("doc_id").cast("string").alias("row_key"), "text", "lang"
    )
    turns = table(spark, sf, "conversations").select(
        F.lit("conversations").alias("dataset"), F.concat_ws("/", "conv_id", "turn").alias("row_key"), "text"
    )
    return rows.union_sources([docs, turns]).withColumn("text_md5", F.md5("text")).drop("text")
