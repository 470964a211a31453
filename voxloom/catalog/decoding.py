"""Token sequences, some of them damaged, back to layers, text and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.catalog.fixtures import CORRUPTED_SQL, corrupted, md5_expr
from voxloom.catalog.registry import register
from voxloom.catalog.sequences import BUILT_SQL, built
from voxloom.functions.arrays import digest
from voxloom.functions.text import arrow_detokenizer
from voxloom.operators import sequences
from voxloom.plans import decoding
from voxloom.vocab import LAYERS

CORRUPT_SQL = BUILT_SQL + CORRUPTED_SQL

DECODED_SQL = (
    CORRUPT_SQL
    + """,
marked AS (
  SELECT *, list_position(ids, 64401) AS s, list_position(ids, 64402) AS e,
    len(list_filter(ids, lambda x: x = 64401)) AS ns, len(list_filter(ids, lambda x: x = 64402)) AS ne
  FROM corrupted),
sliced AS (
  SELECT *, CASE WHEN ns = 0 OR ne = 0 THEN 'missing_marker' WHEN ns > 1 OR ne > 1 THEN 'ambiguous_marker'
      WHEN s >= e THEN 'bad_order' WHEN (e - s - 1) % 4 <> 0 THEN 'partial_frame' END AS early,
    CASE WHEN e > s THEN ids[s + 1:e - 1] ELSE [] END AS audio
  FROM marked),
raw AS (
  SELECT *, list_transform(audio, lambda x, i: x - 64410 - 4032 * ((i - 1) % 4)) AS codes FROM sliced),
judged AS (
  SELECT *, CASE WHEN early IS NOT NULL THEN early
    WHEN len(list_filter(codes, lambda c: c < 0)) > 0 THEN 'negative_code' END AS error
  FROM raw),
decoded AS (
  SELECT doc_id, ids, error, CAST(CASE WHEN error IS NULL THEN len(codes) // 4 END AS INT) AS num_frames,
    """
    + ",\n    ".join(
        f"CASE WHEN error IS NULL THEN list_filter(codes, lambda c, i: (i - 1) % 4 = {k}) END"
        f" AS nano_layer_{k + 1}"
        for k in range(4)
    )
    + """
  FROM judged)
"""
)

POSITIONS_SQL = """,
bounds AS (
  SELECT doc_id, ids, len(ids) AS n, coalesce(list_position(ids, 64401), 0) AS a,
    CASE WHEN coalesce(list_position(ids, 64402), 0) > 0 THEN list_position(ids, 64402) - 1
         ELSE len(ids) END AS e
  FROM corrupted),
rebuilt AS (
  SELECT doc_id, CASE
    WHEN a = 0 THEN range(0, n)
    WHEN e >= a THEN list_transform(range(0, n), lambda i:
      CASE WHEN i < a THEN i
           WHEN i < e THEN a + (i - a) // 4
           ELSE a + (e - a + 3) // 4 + (i - e) END) END AS position_ids
  FROM bounds)
"""


def damaged(spark, sf) -> DataFrame:
    return corrupted(built(spark, sf))


@register(
    "rebuild_positions",
    f"""WITH {CORRUPT_SQL} {POSITIONS_SQL}
    SELECT doc_id, CAST(len(position_ids) AS INT) AS n_positions, {md5_expr("position_ids")} AS md5_positions
    FROM rebuilt""",
)
def rebuild_positions(spark, sf):
    rebuilt = sequences.rebuild_positions(damaged(spark, sf))
    return rebuilt.select(
        "doc_id", F.array_size("position_ids").alias("n_positions"), digest("position_ids").alias("md5_positions")
    )


@register(
    "validate_markers",
    f"""WITH {CORRUPT_SQL}
    SELECT doc_id, CASE WHEN NOT (list_contains(ids, 64401) AND list_contains(ids, 64402))
      THEN 'missing_marker' END AS error FROM corrupted""",
)
def validate_markers(spark, sf):
    return sequences.validate_markers(damaged(spark, sf)).select("doc_id", "error")


LAYER_DIGESTS = ", ".join(f"{md5_expr(name)} AS md5_{name}" for name in LAYERS)


def _layer_digests():
    return [digest(name).alias(f"md5_{name}") for name in LAYERS]


@register(
    "deinterleave_codes",
    f"WITH {DECODED_SQL} SELECT doc_id, error, {LAYER_DIGESTS} FROM decoded",
)
def deinterleave_codes(spark, sf):
    return sequences.deinterleave_codes(damaged(spark, sf)).select("doc_id", "error", *_layer_digests())


@register(
    "deinterleave_codes_strict",
    f"""WITH {DECODED_SQL}
    SELECT doc_id, CASE WHEN error IS NULL AND len(list_filter(
        nano_layer_1 || nano_layer_2 || nano_layer_3 || nano_layer_4, lambda c: c >= 4032)) > 0
      THEN 'code_overflow' ELSE error END AS error FROM decoded""",
)
def deinterleave_codes_strict(spark, sf):
    return sequences.deinterleave_codes(damaged(spark, sf), strict=True).select("doc_id", "error")


SPAN_SQL = """
    CASE WHEN list_position(ids, 2) >= list_position(ids, 1)
         THEN ids[list_position(ids, 1):list_position(ids, 2)] ELSE [] END
"""
TEXT_SQL = "array_to_string(list_transform(span[2:len(span) - 1], lambda x: chr(CAST(x - 3 AS INT))), '')"


@register(
    "extract_text_span",
    f"""WITH {CORRUPT_SQL}, spanned AS (SELECT doc_id, {SPAN_SQL} AS span FROM corrupted)
    SELECT doc_id, CAST(len(span) AS INT) AS n_span, {md5_expr("span")} AS md5_span, md5({TEXT_SQL}) AS md5_text
    FROM spanned""",
)
def extract_text_span(spark, sf):
    spanned = sequences.extract_text_span(damaged(spark, sf))
    return spanned.select(
        "doc_id",
        F.array_size("text_tokens").alias("n_span"),
        digest("text_tokens").alias("md5_span"),
        F.md5("text").alias("md5_text"),
    )


@register(
    "decode_sequences",
    f"""WITH {DECODED_SQL} {POSITIONS_SQL},
    spanned AS (SELECT doc_id, {SPAN_SQL} AS span FROM corrupted)
    SELECT doc_id, error, num_frames, {LAYER_DIGESTS},
           CASE WHEN error IS NULL THEN md5({TEXT_SQL}) END AS md5_text,
           {md5_expr("position_ids")} AS md5_positions
    FROM decoded JOIN rebuilt USING (doc_id) JOIN spanned USING (doc_id)""",
)
def decode_sequences(spark, sf):
    out = decoding.decode_sequences(damaged(spark, sf))
    return out.select(
        "doc_id",
        "error",
        "num_frames",
        *_layer_digests(),
        F.md5("text").alias("md5_text"),
        digest("position_ids").alias("md5_positions"),
    )


# Text ids that spell no text, and a detokenizer of another kind ------------

# Fixed cases by document modulo 10: the id that replaces the first character's.
ODD_IDS = {1: 0, 2: 55300, 3: 60000}


def odd_text(spark, sf) -> DataFrame:
    """Sound sequences, some with a first text id that is no character's."""
    kind = F.col("doc_id") % 10
    at = F.array_position("input_ids", 1).cast("int")
    value = F.get("input_ids", at)
    for k, odd in ODD_IDS.items():
        value = F.when(kind == k, F.lit(odd)).otherwise(value)
    rest = F.slice("input_ids", at + 2, F.array_size("input_ids"))
    return built(spark, sf).select("doc_id", F.concat(F.slice("input_ids", 1, at), F.array(value), rest).alias("ids"))


ODD_SQL = BUILT_SQL + """,
spelled AS (SELECT doc_id, prompt, input_ids, CAST(list_position(input_ids, 1) AS INT) AS spot FROM built),
corrupted AS (
  SELECT doc_id, prompt, input_ids[1:spot] || [CASE doc_id % 10 {} ELSE input_ids[spot + 1] END]
    || input_ids[spot + 2:len(input_ids)] AS ids FROM spelled),
texts AS (
  SELECT doc_id, CASE WHEN doc_id % 10 NOT IN ({}) THEN prompt END AS text FROM corrupted)
""".format(" ".join(f"WHEN {k} THEN {v}" for k, v in ODD_IDS.items()), ", ".join(map(str, ODD_IDS)))


@register(
    "extract_text_span_odd_ids",
    f"WITH {ODD_SQL} SELECT doc_id, md5(text) AS md5_text FROM texts",
)
def extract_text_span_odd_ids(spark, sf):
    return sequences.extract_text_span(odd_text(spark, sf)).select("doc_id", F.md5("text").alias("md5_text"))


@register(
    "decode_sequences_odd_ids",
    f"WITH {ODD_SQL} SELECT doc_id, CASE WHEN text IS NULL THEN 'bad_text' END AS error, md5(text) AS md5_text FROM texts",
)
def decode_sequences_odd_ids(spark, sf):
    out = decoding.decode_sequences(odd_text(spark, sf))
    return out.select("doc_id", "error", F.md5("text").alias("md5_text"))


def load_letters():
    """A detokenizer from a table: id modulo 26 is a letter; id 55300 is no piece of it."""
    letters = [chr(97 + i) for i in range(26)]

    def decode(lists: list[list[int]]) -> list[str | None]:
        return [None if 55300 in ids else "".join(letters[i % 26] for i in ids) for ids in lists]

    return decode


@register(
    "decode_sequences_detokenizer",
    f"""WITH {ODD_SQL}, spans AS (SELECT doc_id, {SPAN_SQL} AS span FROM corrupted),
    inner_ids AS (SELECT doc_id, span[2:len(span) - 1] AS v FROM spans),
    said AS (
      SELECT doc_id, CASE WHEN NOT list_contains(v, 55300)
        THEN array_to_string(list_transform(v, lambda x: chr(CAST(97 + x % 26 AS INT))), '') END AS text FROM inner_ids)
    SELECT doc_id, CASE WHEN text IS NULL THEN 'bad_text' END AS error, md5(text) AS md5_text FROM said""",
)
def decode_sequences_detokenizer(spark, sf):
    out = decoding.decode_sequences(odd_text(spark, sf), detokenizer=arrow_detokenizer(load_letters))
    return out.select("doc_id", "error", F.md5("text").alias("md5_text"))
