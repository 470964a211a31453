"""Tokens, training columns and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.catalog.fixtures import (
    DOCS_SQL,
    ENCODED_SQL,
    MAX_SECONDS,
    PROMPT_EXPR,
    TOKENS_EXPR,
    built_sql,
    char_ids_expr,
    documents,
    encoded,
    md5_expr,
    sum_expr,
)
from voxloom.catalog.registry import register
from voxloom.functions.arrays import digest, int_sum
from voxloom.functions.text import batch_char_tokenizer
from voxloom.operators import sequences
from voxloom.plans.training import build_parts, sound_rows

BUILT_SQL = ENCODED_SQL + built_sql()


def parts(spark, sf) -> DataFrame:
    rows = sound_rows(encoded(spark, sf), max_seconds=MAX_SECONDS)
    return build_parts(rows, tokenizer=batch_char_tokenizer())


def built(spark, sf) -> DataFrame:
    return sequences.add_training_columns(parts(spark, sf))


def summarise(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """A whole array column as its size, sum and digest."""
    return df.select(
        *keys,
        F.array_size(column).alias(f"n_{column}"),
        int_sum(column).alias(f"sum_{column}"),
        digest(column).alias(f"md5_{column}"),
    )


def summary_sql(column: str, name: str | None = None) -> str:
    name = name or column
    return (
        f"CAST(len({column}) AS INT) AS n_{name}, {sum_expr(column)} AS sum_{name}, {md5_expr(column)} AS md5_{name}"
    )


@register(
    "tokenize_text",
    f"""WITH {DOCS_SQL}, prompted AS (SELECT doc_id, {PROMPT_EXPR} AS prompt FROM docs),
    tokens AS (SELECT doc_id, {TOKENS_EXPR} AS text_tokens FROM prompted)
    SELECT doc_id, {summary_sql("text_tokens")} FROM tokens""",
)
def tokenize_text(spark, sf):
    return summarise(sequences.tokenize_text(documents(spark, sf)), "text_tokens", "doc_id")


@register("build_input_ids", f"WITH {BUILT_SQL} SELECT doc_id, {summary_sql('input_ids')} FROM built")
def build_input_ids(spark, sf):
    return summarise(sequences.build_input_ids(parts(spark, sf)), "input_ids", "doc_id")


@register("frame_position_ids", f"WITH {BUILT_SQL} SELECT doc_id, {summary_sql('position_ids')} FROM built")
def frame_position_ids(spark, sf):
    return summarise(built(spark, sf), "position_ids", "doc_id")


@register("labels", f"WITH {BUILT_SQL} SELECT doc_id, {summary_sql('input_ids', 'labels')} FROM built")
def labels(spark, sf):
    return summarise(built(spark, sf), "labels", "doc_id")


@register(
    "attention_mask",
    f"""WITH {BUILT_SQL}, masked AS (
      SELECT doc_id, list_transform(input_ids, lambda x: 1) AS attention_mask FROM built)
    SELECT doc_id, {summary_sql("attention_mask")} FROM masked""",
)
def attention_mask(spark, sf):
    return summarise(built(spark, sf), "attention_mask", "doc_id")


@register(
    "training_projection",
    f"""WITH {BUILT_SQL}
    SELECT row_key, {md5_expr("input_ids")} AS input_ids, {md5_expr("input_ids")} AS labels,
           {md5_expr("list_transform(input_ids, lambda x: 1)")} AS attention_mask,
           {md5_expr("position_ids")} AS position_ids
    FROM built""",
)
def training_projection(spark, sf):
    rows = sequences.training_projection(built(spark, sf), "row_key")
    return rows.select("row_key", *[digest(c).alias(c) for c in rows.columns if c != "row_key"])


@register(
    "prompt_sequence",
    f"""WITH {DOCS_SQL}, prompted AS (SELECT doc_id, {PROMPT_EXPR} AS prompt FROM docs),
    asked AS (
      SELECT doc_id, [64403, 1] || {char_ids_expr("prompt")} || [2, 64404] AS input_ids FROM prompted)
    SELECT doc_id, {summary_sql("input_ids")},
           {md5_expr("list_transform(input_ids, lambda x: 1)")} AS md5_attention_mask,
           {md5_expr("range(0, len(input_ids))")} AS md5_position_ids
    FROM asked""",
)
def prompt_sequence(spark, sf):
    asked = sequences.prompt_sequence(documents(spark, sf))
    return asked.select(
        "doc_id",
        F.array_size("input_ids").alias("n_input_ids"),
        int_sum("input_ids").alias("sum_input_ids"),
        digest("input_ids").alias("md5_input_ids"),
        digest("attention_mask").alias("md5_attention_mask"),
        digest("position_ids").alias("md5_position_ids"),
    )
