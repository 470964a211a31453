"""Inputs that Spark derives from the given tables, and the same in SQL.

The tables hold no audio, so code layers, audio values and token sequences are
derived from ids and whole texts by integer formulas that both engines share.
Derived columns have the same names on both sides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.arrays import empty_ints, int_array
from voxloom.operators.encode import CodecDecoder, Encoder, Extractor, Generator
from voxloom.vocab import DEFAULT_LAYOUT, LAYERS, SAMPLE_RATE

MAX_SECONDS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts; Spanish ones have no speaker."""
    return speakers(table(spark, sf_dir, "documents"))


def speakers(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("row_key"),
        "text",
        "lang",
        F.when(F.col("lang") != "es", F.col("source")).alias("speaker"),
    )


DOCS_SQL = """
docs AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS row_key, text, lang,
         CASE WHEN lang <> 'es' THEN source END AS speaker,
         CAST(1 + (doc_id * 7) % 500 AS INT) AS n
  FROM documents)
"""


def derived_layers(docs: DataFrame) -> DataFrame:
    """Documents as encoded rows: 1 to 500 frames, runs of 1 to 3 equal frames.

    The layers come out of a one-element ``inline``: like stored columns, they
    are computed once, and no predicate on them is pushed into their formulas.
    """
    n = (F.lit(1) + (F.col("doc_id") * 7) % 500).cast("int")
    run = (F.lit(1) + F.col("doc_id") % 3).cast("int")

    def layer(k: int) -> Column:
        """One code per run of equal frames, then every code as often as its run is long."""
        start, step = F.col("doc_id") * (31 * k), F.lit(17 * k).cast("bigint")
        steps = F.sequence(start, start + F.floor((F.col("encoded_len") - 1) / F.col("_run")) * step, step)
        single = F.transform(steps, lambda v: (v % 4032).cast("int"))
        repeated = F.flatten(F.transform(steps, lambda v: F.array_repeat((v % 4032).cast("int"), F.col("_run"))))
        return F.when(F.col("_run") == 1, single).otherwise(F.slice(repeated, F.lit(1), F.col("encoded_len")))

    layers = F.struct(*[layer(k).alias(name) for k, name in enumerate(LAYERS, start=1)])
    sized = docs.withColumn("encoded_len", n).withColumn("_run", run)
    return sized.select(*docs.columns, "encoded_len", F.inline(F.array(layers)))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_layers(documents(spark, sf_dir))


def _layer_sql(k: int) -> str:
    return (
        f"list_transform(range(0, n), lambda i: CAST((doc_id * {31 * k}"
        f" + (i // (1 + doc_id % 3)) * {17 * k}) % 4032 AS INT)) AS nano_layer_{k}"
    )


ENCODED_SQL = (
    DOCS_SQL
    + f""",
encoded AS (
  SELECT doc_id, row_key, text, lang, speaker, n AS encoded_len,
         {", ".join(_layer_sql(k) for k in (1, 2, 3, 4))}
  FROM docs)
"""
)


def frames_sql(source: str, into: str, dedup: bool = True) -> str:
    """Two steps: zip the layers of ``source``, then drop repeated frames."""
    kept = "list_filter(f, lambda x, i: i = 1 OR x <> f[i - 1])" if dedup else "f"
    return f""",
{into}_zipped AS (
  SELECT *, list_transform(range(1, len(nano_layer_1) + 1),
    lambda i: [nano_layer_1[i], nano_layer_2[i], nano_layer_3[i], nano_layer_4[i]]) AS f
  FROM {source}),
{into} AS (
  SELECT * EXCLUDE (f), {kept} AS frames FROM {into}_zipped)
"""


CODES_EXPR = """flatten(list_transform(frames,
    lambda x: [x[1] + 64410, x[2] + 68442, x[3] + 72474, x[4] + 76506]))"""

PROMPT_EXPR = "CASE WHEN speaker IS NOT NULL THEN lower(speaker) || ': ' || text ELSE text END"


def char_ids_expr(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: 3 + unicode(c))"


TOKENS_EXPR = f"[1] || {char_ids_expr('prompt')} || [2]"


def built_sql(source: str = "encoded", where: str = "encoded_len / 12.5 <= 30") -> str:
    """Sound rows of ``source`` with ``input_ids`` and ``position_ids``."""
    return (
        f""",
chosen AS (SELECT *, {PROMPT_EXPR} AS prompt FROM {source} WHERE {where})"""
        + frames_sql("chosen", "framed")
        + f""",
parts AS (
  SELECT *, {CODES_EXPR} AS codes, len(frames) AS n_frames, {TOKENS_EXPR} AS text_tokens
  FROM framed),
built AS (
  SELECT *,
    [64403] || text_tokens || [64404, 64405, 64401] || codes || [64402, 64406] AS input_ids,
    range(0, len(text_tokens) + 4)
      || list_transform(range(0, len(codes)), lambda j: len(text_tokens) + 4 + j // 4)
      || [len(text_tokens) + 4 + n_frames, len(text_tokens) + 5 + n_frames] AS position_ids
  FROM parts)
"""
    )


def md5_expr(values: str) -> str:
    return f"md5(array_to_string({values}, ','))"


def sum_expr(values: str) -> str:
    return f"CAST(coalesce(list_sum({values}), 0) AS BIGINT)"


# Bad encoded rows ---------------------------------------------------------


def bad_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded rows, some with a null, ragged or empty layer, a null code, length or text."""
    return damage_encoded(encoded(spark, sf_dir))


def damage_encoded(rows: DataFrame) -> DataFrame:
    kind = F.col("doc_id") % 50
    layers = {
        "nano_layer_1": F.when(kind == 3, empty_ints()).otherwise(F.col("nano_layer_1")),
        "nano_layer_2": F.when(kind == 1, F.lit(None))
        .when(kind == 3, empty_ints())
        .otherwise(F.col("nano_layer_2")),
        "nano_layer_3": F.when(kind == 3, empty_ints())
        .when(kind == 2, F.slice("nano_layer_3", 1, F.array_size("nano_layer_3") - 1))
        .otherwise(F.col("nano_layer_3")),
        "nano_layer_4": F.when(kind == 3, empty_ints())
        .when(kind == 6, F.concat(F.slice("nano_layer_4", 2, F.array_size("nano_layer_4") - 1), F.array(F.lit(None).cast("int"))))
        .otherwise(F.col("nano_layer_4")),
        "encoded_len": F.when(kind != 4, F.col("encoded_len")),
        "text": F.when(kind != 5, F.col("text")),
    }
    return rows.withColumns(layers)


BAD_ENCODED_SQL = (
    ENCODED_SQL
    + """,
bad AS (
  SELECT doc_id, row_key, lang, speaker,
    CASE WHEN doc_id % 50 <> 5 THEN text END AS text,
    CASE WHEN doc_id % 50 <> 4 THEN encoded_len END AS encoded_len,
    CASE doc_id % 50 WHEN 3 THEN [] ELSE nano_layer_1 END AS nano_layer_1,
    CASE doc_id % 50 WHEN 1 THEN NULL WHEN 3 THEN [] ELSE nano_layer_2 END AS nano_layer_2,
    CASE doc_id % 50 WHEN 3 THEN [] WHEN 2 THEN nano_layer_3[1:len(nano_layer_3) - 1]
         ELSE nano_layer_3 END AS nano_layer_3,
    CASE doc_id % 50 WHEN 3 THEN [] WHEN 6 THEN nano_layer_4[2:len(nano_layer_4)] || [NULL]
         ELSE nano_layer_4 END AS nano_layer_4
  FROM encoded),
checked AS (
  SELECT *, CASE
    WHEN encoded_len IS NULL THEN 'null_encoded_len'
    WHEN nano_layer_1 IS NULL OR nano_layer_2 IS NULL OR nano_layer_3 IS NULL OR nano_layer_4 IS NULL
      THEN 'null_layer'
    WHEN len(nano_layer_2) <> len(nano_layer_1) OR len(nano_layer_3) <> len(nano_layer_1)
      OR len(nano_layer_4) <> len(nano_layer_1) THEN 'ragged_layers'
    WHEN len(nano_layer_1) = 0 THEN 'empty_layers'
    WHEN len(list_filter(nano_layer_1 || nano_layer_2 || nano_layer_3 || nano_layer_4, lambda c: c IS NULL)) > 0
      THEN 'null_code'
    WHEN text IS NULL THEN 'null_text' END AS error
  FROM bad)
"""
)


# Token sequences, some corrupted ------------------------------------------


def corrupted(built: DataFrame) -> DataFrame:
    """``ids`` from ``input_ids``, damaged in one of seven ways by ``doc_id``.

    A sequence is head, start marker, audio, end marker, last token.  Each way
    replaces a marker or leaves out some audio tokens.
    """
    layout = DEFAULT_LAYOUT
    start, end = layout.start_of_speech, layout.end_of_speech
    located = built.select(
        "doc_id",
        (F.col("doc_id") % 8).alias("kind"),
        "input_ids",
        F.array_position("input_ids", start).cast("int").alias("at"),
        F.array_size("input_ids").alias("size"),
    ).withColumn("n", F.expr("size - 2 - at"))
    first, second = F.get("input_ids", F.col("at")), F.get("input_ids", F.col("at") + 1)
    opening = (
        F.when(F.col("kind") == 1, empty_ints())
        .when(F.col("kind") == 2, int_array([end]))
        .when(F.col("kind") == 5, int_array([start, start]))
        .when(F.col("kind") == 6, F.array(F.lit(start), second, first))
        .otherwise(int_array([start]))
    )
    closing = (
        F.when(F.col("kind") == 1, empty_ints())
        .when(F.col("kind") == 2, int_array([start]))
        .when(F.col("kind") == 7, int_array([99999, end]))
        .otherwise(int_array([end]))
    )
    skipped = F.expr("CASE kind WHEN 3 THEN 1 WHEN 4 THEN n WHEN 6 THEN 2 ELSE 0 END")
    dropped = F.expr("CASE kind WHEN 7 THEN 1 ELSE 0 END")
    ids = F.concat(
        F.slice("input_ids", 1, F.col("at") - 1),
        opening,
        F.slice("input_ids", F.col("at") + 1 + skipped, F.col("n") - skipped - dropped),
        closing,
        F.slice("input_ids", F.col("size"), 1),
    )
    return located.select("doc_id", ids.alias("ids"))


CORRUPTED_SQL = """,
located AS (
  SELECT doc_id, input_ids AS v, list_position(input_ids, 64401) AS p, len(input_ids) AS sz FROM built),
corrupted AS (
  SELECT doc_id, CASE doc_id % 8
    WHEN 1 THEN list_filter(v, lambda x: x <> 64401 AND x <> 64402)
    WHEN 2 THEN v[1:p - 1] || [64402] || v[p + 1:sz - 2] || [64401] || v[sz:sz]
    WHEN 3 THEN v[1:p] || v[p + 2:sz]
    WHEN 4 THEN v[1:p] || v[sz - 1:sz]
    WHEN 5 THEN v[1:p] || [64401] || v[p + 1:sz]
    WHEN 6 THEN v[1:p] || [v[p + 2], v[p + 1]] || v[p + 3:sz]
    WHEN 7 THEN v[1:sz - 3] || [99999] || v[sz - 1:sz]
    ELSE v END AS ids
  FROM located)
"""


# Audio --------------------------------------------------------------------

FRAME_SAMPLES = 16


def raw_pcm_decoder(data: bytes) -> tuple[np.ndarray, int]:
    """Every byte is one unsigned 8-bit sample at the codec's rate."""
    return (np.frombuffer(data, np.uint8).astype(np.float32) - 128.0) / 128.0, SAMPLE_RATE


def load_sum_encoder() -> Encoder:
    """Stand-in codec: a frame's codes are multiples of its sample sum."""

    def encode(wave: np.ndarray) -> tuple[list[np.ndarray], int]:
        levels = np.rint(wave * 128.0 + 128.0).astype(np.int64)
        frames = -(-len(levels) // FRAME_SAMPLES)
        padded = np.zeros(frames * FRAME_SAMPLES, np.int64)
        padded[: len(levels)] = levels
        sums = padded.reshape(frames, FRAME_SAMPLES).sum(axis=1)
        return [(sums * k + 7 * k) % 4032 for k in (1, 2, 3, 4)], frames

    return encode


def load_sum_decoder() -> CodecDecoder:
    """Stand-in decoder: one sample per frame, a weighted sum of its codes."""
    return lambda codes: (codes * np.array([[1], [2], [3], [4]])).sum(axis=0) / 65536.0


def load_echo_generator() -> Generator:
    """Stand-in speech: the characters of speaker and text as samples."""

    def generate(text: str, speaker: str | None) -> np.ndarray:
        points = np.frombuffer(f"{speaker or ''}{text}".encode("utf-32-le"), np.uint32)
        return (points % 256) / 256.0

    return generate


def load_reshape_extractor() -> Extractor:
    """Stand-in features: the waveform itself, cut into columns of fixed height."""

    def extract(wave: np.ndarray) -> dict[str, np.ndarray]:
        def cut(height: int) -> np.ndarray:
            frames = -(-len(wave) // height)
            padded = np.zeros(frames * height)
            padded[: len(wave)] = wave
            return padded.reshape(frames, height).T

        return {"mfcc": cut(13), "chroma": cut(12), "centroid": cut(1)}

    return extract
