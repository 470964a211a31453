"""Duration, frames, codes and build errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog.fixtures import (
    BAD_ENCODED_SQL,
    CODES_EXPR,
    ENCODED_SQL,
    MAX_SECONDS,
    bad_encoded,
    char_ids_expr,
    encoded,
    frames_sql,
    md5_expr,
    sum_expr,
    table,
)
from voxloom.catalog.registry import register
from voxloom.functions import frames as fx
from voxloom.functions.arrays import digest, empty_ints, int_sum
from voxloom.operators import frames
from voxloom.vocab import LAYERS


@register(
    "duration_filter",
    f"WITH {ENCODED_SQL} SELECT doc_id, encoded_len FROM encoded WHERE encoded_len / 12.5 <= 30",
)
def duration_filter(spark, sf):
    return frames.duration_filter(encoded(spark, sf), MAX_SECONDS).select("doc_id", "encoded_len")


@register(
    "filter_report",
    f"""WITH {ENCODED_SQL}
    SELECT count(*) AS rows_before, count(*) FILTER (encoded_len / 12.5 <= 30) AS rows_after FROM encoded""",
)
def filter_report(spark, sf):
    return frames.filter_report(encoded(spark, sf), MAX_SECONDS)


@register(
    "frames_to_seconds",
    f"WITH {ENCODED_SQL} SELECT doc_id, encoded_len / 12.5::DOUBLE AS seconds FROM encoded",
)
def frames_to_seconds(spark, sf):
    return encoded(spark, sf).select("doc_id", fx.frames_to_seconds("encoded_len").alias("seconds"))


def _frame_digest(column: str):
    flat = F.flatten(F.transform(column, lambda f: F.array(*[f[name] for name in LAYERS])))
    return digest(flat)


@register(
    "dedup_consecutive_frames",
    f"""WITH {ENCODED_SQL} {frames_sql("encoded", "framed")}
    SELECT doc_id, CAST(len(frames) AS INT) AS n_frames, {md5_expr("flatten(frames)")} AS frames_md5 FROM framed""",
)
def dedup_consecutive_frames(spark, sf):
    framed = frames.add_frames(encoded(spark, sf))
    return framed.select(
        "doc_id", F.array_size("frames").alias("n_frames"), _frame_digest("frames").alias("frames_md5")
    )


@register(
    "frame_count",
    f"""WITH {ENCODED_SQL} {frames_sql("encoded", "framed")}
    SELECT doc_id, encoded_len, CAST(len(frames) AS INT) AS num_audio_frames FROM framed""",
)
def frame_count(spark, sf):
    return frames.add_codes(frames.add_frames(encoded(spark, sf))).select(
        "doc_id", "encoded_len", "num_audio_frames"
    )


@register(
    "interleave_layers",
    f"""WITH {ENCODED_SQL} {frames_sql("encoded", "framed", dedup=False)},
    coded AS (SELECT *, {CODES_EXPR} AS codes FROM framed)
    SELECT doc_id, CAST(len(codes) AS INT) AS n_codes, {sum_expr("codes")} AS sum_codes,
           {md5_expr("codes")} AS codes_md5 FROM coded""",
)
def interleave_layers(spark, sf):
    coded = frames.add_codes(frames.add_frames(encoded(spark, sf), dedup=False))
    return coded.select(
        "doc_id",
        F.array_size("codes_list").alias("n_codes"),
        int_sum("codes_list").alias("sum_codes"),
        digest("codes_list").alias("codes_md5"),
    )


@register(
    "drop_empty_codes",
    f"""WITH {ENCODED_SQL} {frames_sql("encoded", "framed")},
    coded AS (
      SELECT doc_id, CASE doc_id % 50 WHEN 1 THEN NULL WHEN 3 THEN [] ELSE {CODES_EXPR} END AS codes_list
      FROM framed)
    SELECT doc_id, CAST(len(codes_list) AS INT) AS n_codes FROM coded
    WHERE codes_list IS NOT NULL AND len(codes_list) > 0""",
)
def drop_empty_codes(spark, sf):
    kind = F.col("doc_id") % 50
    coded = frames.add_codes(frames.add_frames(encoded(spark, sf)))
    damaged = coded.withColumn(
        "codes_list",
        F.when(kind == 1, F.lit(None)).when(kind == 3, empty_ints()).otherwise(F.col("codes_list")),
    )
    return frames.drop_empty_codes(damaged).select("doc_id", F.array_size("codes_list").alias("n_codes"))


@register("build_errors", f"WITH {BAD_ENCODED_SQL} SELECT doc_id, error FROM checked WHERE error IS NOT NULL")
def build_errors(spark, sf):
    checked = frames.build_errors(bad_encoded(spark, sf))
    return checked.where("error IS NOT NULL").select("doc_id", "error")


@register(
    "mono_downmix",
    f"""
    WITH stereo AS (
      SELECT doc_id, list_transform({char_ids_expr("text")}, lambda v:
        [(v % 256 - 128) / 128.0::DOUBLE, ((v * 7) % 256 - 128) / 128.0::DOUBLE]) AS samples
      FROM documents),
    mono AS (
      SELECT doc_id, list_transform(samples, lambda c: (c[1] + c[2]) / 2) AS wave FROM stereo)
    SELECT doc_id, CAST(len(wave) AS INT) AS n_samples, list_sum(wave) AS sum_wave,
           {md5_expr("list_transform(wave, lambda x: CAST(x * 256 AS INT))")} AS wave_md5
    FROM mono
    """,
)
def mono_downmix(spark, sf):
    from voxloom.functions.text import char_ids

    samples = F.transform(
        char_ids("text"),
        lambda v: F.array((v % 256 - 128) / F.lit(128.0), ((v * 7) % 256 - 128) / F.lit(128.0)),
    )
    mono = table(spark, sf, "documents").select("doc_id", samples.alias("samples"))
    mono = mono.select("doc_id", fx.mono_downmix("samples", channels=2).alias("wave"))
    return mono.select(
        "doc_id",
        F.array_size("wave").alias("n_samples"),
        F.aggregate("wave", F.lit(0.0), lambda acc, v: acc + v).alias("sum_wave"),
        digest(F.transform("wave", lambda x: (x * 256).cast("int"))).alias("wave_md5"),
    )
