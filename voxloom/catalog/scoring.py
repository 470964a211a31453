"""Similarities, pairs and evaluation.

A vector of the embeddings table stands for a recording: 64 samples at the
codec's rate, or a small feature matrix.  The generated partner of sample v is
vector v + 1, so the last sample has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.catalog.fixtures import (
    ENCODED_SQL,
    encoded,
    load_reshape_extractor,
    md5_expr,
    table,
)
from voxloom.catalog.registry import register
from voxloom.functions import vectors as vx
from voxloom.functions.arrays import digest, truncate_to_shorter as cut_both
from voxloom.functions.text import char_ids
from voxloom.operators import encode, scoring
from voxloom.operators.report import eval_report
from voxloom.plans import evaluation
from voxloom.specs import EvaluationRequest
from voxloom.vocab import SAMPLE_RATE

# Vectors ------------------------------------------------------------------


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_index"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def partners(df: DataFrame) -> DataFrame:
    return df.withColumn("sample_index", F.col("sample_index") - 1)


VECTORS_SQL = """
vectors AS (SELECT vec_id AS sample_index, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
vector_pairs AS (
  SELECT r.sample_index, r.vec AS a, g.vec AS b
  FROM vectors r JOIN vectors g ON g.sample_index = r.sample_index + 1)
"""


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


def cosine_sql(a: str, b: str) -> str:
    aa, bb = dot_sql(a, a), dot_sql(b, b)
    return f"CASE WHEN {aa} = 0 OR {bb} = 0 THEN 0.0 ELSE {dot_sql(a, b)} / (sqrt({aa}) * sqrt({bb})) END"


def cut_sql(vec: str, height: int) -> str:
    """A vector as a matrix of ``height`` features by frames, zeros at the end."""
    frames = f"(len({vec}) + {height - 1}) // {height}"
    return f"""list_transform(range(0, {height}), lambda k: list_transform(range(0, {frames}),
        lambda t: coalesce({vec}[t * {height} + k + 1], 0.0)))"""


def pooled_sql(matrix: str) -> str:
    return f"list_transform({matrix}, lambda r: list_sum(r) / len(r))"


def dtw_steps_sql(source: str, keys: str, a: str = "a", b: str = "b") -> str:
    """Alignment cost of matrices ``a`` and ``b`` (features by frames), row by row."""
    return f"""
    grid AS (
      SELECT {keys}, len({a}[1]) AS n, len({b}[1]) AS m,
        list_transform(range(1, len({a}[1]) + 1), lambda i: list_transform(range(1, len({b}[1]) + 1),
          lambda j: sqrt(list_sum(list_transform(range(1, len({a}) + 1),
            lambda k: ({a}[k][i] - {b}[k][j]) * ({a}[k][i] - {b}[k][j])))))) AS c
      FROM {source}),
    walk AS (
      SELECT {keys}, n, m, c, 1 AS i,
        list_transform(range(1, m + 1), lambda j: list_sum(c[1][1:j])) AS row FROM grid
      UNION ALL
      SELECT {keys}, n, m, c, i + 1,
        list_reduce(
          list_transform(range(1, m + 1), lambda j:
            [c[i + 1][j], least(row[j], CASE WHEN j > 1 THEN row[j - 1] ELSE row[j] END)]),
          lambda acc, x: acc || [x[1] + least(x[2], coalesce(acc[len(acc)], x[2]))],
          CAST([] AS DOUBLE[]))
      FROM walk WHERE i < n),
    aligned AS (
      SELECT {keys}, 1.0 / (1.0 + row[m] / (n + m)) AS similarity FROM walk WHERE i = n)
    """


@register(
    "mean_pool",
    """
    SELECT label, coeff, round(avg(value), 6) AS pooled FROM (
      SELECT label, CAST(unnest(range(0, 64)) AS INT) AS coeff, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)
    GROUP BY label, coeff
    """,
)
def mean_pool(spark, sf):
    """A label's vectors are the frames of one sample in a long feature table."""
    long = vectors(spark, sf).select("label", F.posexplode("vec").alias("coeff", "value"))
    pooled = scoring.mean_pool_long(long, by=["label", "coeff"])
    return pooled.withColumn("pooled", F.round("pooled", 6))


@register(
    "mean_pool_matrix",
    f"""
    WITH {VECTORS_SQL},
    pooled AS (SELECT sample_index, {pooled_sql(cut_sql("vec", 4))} AS p FROM vectors)
    SELECT sample_index, round(p[1], 6) AS p1, round(p[2], 6) AS p2, round(p[3], 6) AS p3, round(p[4], 6) AS p4
    FROM pooled
    """,
)
def mean_pool_matrix(spark, sf):
    pooled = vectors(spark, sf).select("sample_index", vx.mean_pool(matrix("vec", 4)).alias("p"))
    return pooled.select("sample_index", *[F.round(F.get("p", k), 6).alias(f"p{k + 1}") for k in range(4)])


def matrix(vec: str, height: int):
    """A vector as ``height`` features by frames, without padding."""
    return F.array(*[F.filter(vec, _every(height, k)) for k in range(height)])


def _every(step: int, k: int):
    return lambda _, i: i % step == k


@register(
    "truncate_to_shorter",
    f"""WITH {ENCODED_SQL},
    both_sides AS (
      SELECT doc_id, nano_layer_1 AS a, list_transform(string_split(text, ''), lambda c: 3 + unicode(c)) AS b
      FROM encoded),
    cut AS (SELECT doc_id, a[1:least(len(a), len(b))] AS a, b[1:least(len(a), len(b))] AS b FROM both_sides)
    SELECT doc_id, CAST(len(a) AS INT) AS n_a, CAST(len(b) AS INT) AS n_b, {md5_expr("a")} AS md5_a, {md5_expr("b")} AS md5_b FROM cut""",
)
def truncate_to_shorter(spark, sf):
    df = encoded(spark, sf).select("doc_id", F.col("nano_layer_1").alias("a"), char_ids("text").alias("b"))
    a, b = cut_both("a", "b")
    cut = df.select("doc_id", a.alias("a"), b.alias("b"))
    return cut.select(
        "doc_id", F.array_size("a").alias("n_a"), F.array_size("b").alias("n_b"),
        digest("a").alias("md5_a"), digest("b").alias("md5_b"),
    )


def vector_pairs(spark, sf) -> DataFrame:
    df = vectors(spark, sf).select("sample_index", "vec")
    paired = scoring.pair_reference_generated(df, partners(df))
    return paired.where("error IS NULL").drop("error")


@register(
    "cosine_similarity",
    f"WITH {VECTORS_SQL} SELECT sample_index, round({cosine_sql('a', 'b')}, 4) AS similarity FROM vector_pairs",
)
def cosine_similarity(spark, sf):
    similarity = vx.round_metric(vx.cosine_similarity("vec", "gen_vec"))
    return vector_pairs(spark, sf).select("sample_index", similarity.alias("similarity"))


@register(
    "dtw_similarity",
    f"""WITH RECURSIVE {VECTORS_SQL},
    matrices AS (
      SELECT sample_index, {cut_sql("a", 4)} AS a, {cut_sql("b", 4)} AS b FROM vector_pairs),
    {dtw_steps_sql("matrices", "sample_index")}
    SELECT sample_index, round(similarity, 4) AS similarity FROM aligned""",
)
def dtw_similarity(spark, sf):
    similarity = vx.dtw_similarity(matrix("vec", 4), matrix("gen_vec", 4))
    scored = vector_pairs(spark, sf).withColumn("similarity", similarity)
    return scored.select("sample_index", vx.round_metric("similarity").alias("similarity"))


# Score rows ---------------------------------------------------------------

# Fixed formulas of the derived score rows: metric -> (factor, modulus).
SCORE_PARTS = {
    "mfcc_similarity": (1, 97),
    "chroma_similarity": (3, 89),
    "spectral_centroid_similarity": (5, 83),
    "dtw_similarity": (7, 79),
}


def score_rows(spark, sf) -> DataFrame:
    """Unrounded similarities from the document id; every 25th row has an error instead."""
    failed = F.col("doc_id") % 25 == 0
    parts = {
        name: F.when(~failed, ((F.col("doc_id") * f) % m) / F.lit(float(m))) for name, (f, m) in SCORE_PARTS.items()
    }
    return (
        table(spark, sf, "documents")
        .select(F.col("doc_id").alias("sample_index"), "text", F.col("doc_id"))
        .withColumns({**parts, "error": F.when(failed, F.lit("decode_failed"))})
        .drop("doc_id")
    )


SCORES_SQL = (
    "scores AS (SELECT doc_id AS sample_index, text, "
    + ", ".join(
        f"CASE WHEN doc_id % 25 <> 0 THEN ((doc_id * {f}) % {m}) / {m}.0::DOUBLE END AS {name}"
        for name, (f, m) in SCORE_PARTS.items()
    )
    + ", CASE WHEN doc_id % 25 = 0 THEN 'decode_failed' END AS error FROM documents),"
    + " weighted AS (SELECT *, 0.35::DOUBLE * mfcc_similarity + 0.25::DOUBLE * chroma_similarity"
    + " + 0.15::DOUBLE * spectral_centroid_similarity + 0.25::DOUBLE * dtw_similarity AS overall_score FROM scores)"
)
ROUNDED_SQL = ", ".join(f"round({name}, 4) AS {name}" for name in vx.METRICS)
METRICS_SQL = ", ".join(vx.METRICS)


def summary_sql(rows: str) -> str:
    means = ", ".join(
        f"coalesce(round(avg({name}) FILTER (overall_score IS NOT NULL), 4), 0.0) AS {name}" for name in vx.METRICS
    )
    return f"""SELECT {means}, count(overall_score) AS samples_evaluated,
        count(*) FILTER (overall_score IS NULL) AS samples_failed FROM {rows}"""


@register(
    "overall_score",
    f"WITH {SCORES_SQL} SELECT sample_index, round(overall_score, 10) AS overall_score FROM weighted",
)
def overall_score(spark, sf):
    scored = scoring.overall_score(score_rows(spark, sf))
    return scored.select("sample_index", F.round("overall_score", 10).alias("overall_score"))


@register("round_metrics", f"WITH {SCORES_SQL} SELECT sample_index, {ROUNDED_SQL} FROM weighted")
def round_metrics(spark, sf):
    rounded = scoring.round_metrics(scoring.overall_score(score_rows(spark, sf)))
    return rounded.select("sample_index", *vx.METRICS)


@register(
    "eval_errors",
    f"""WITH {SCORES_SQL}
    SELECT sample_index, substring(text, 1, 100) AS text, {ROUNDED_SQL}, error FROM weighted""",
)
def eval_errors(spark, sf):
    return scoring.eval_samples(scoring.round_metrics(scoring.overall_score(score_rows(spark, sf))))


@register(
    "eval_summary",
    f"WITH {SCORES_SQL}, rounded AS (SELECT sample_index, {ROUNDED_SQL} FROM weighted) {summary_sql('rounded')}",
)
def eval_summary(spark, sf):
    return scoring.eval_summary(eval_errors(spark, sf))


# Whole evaluation ---------------------------------------------------------

REQUEST = EvaluationRequest("embeddings", text_column="sentence", speaker_column="label_name")


def recordings(spark, sf) -> DataFrame:
    """Vectors as decoded audio; class 7 has no audio and class 3 no text."""
    label = F.col("label")
    audio = F.struct(F.col("embedding").alias("array"), F.lit(SAMPLE_RATE).alias("sampling_rate"))
    sentence = F.concat_ws(" ", F.lit("sample"), "vec_id", F.lit("of class"), label)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_index"),
        F.when(label != 7, audio).alias("audio"),
        F.when(label == 3, F.lit("")).otherwise(sentence).alias("sentence"),
        F.concat(F.lit("voice"), label.cast("string")).alias("label_name"),
    )


def generated(spark, sf) -> DataFrame:
    audio = F.struct(F.col("embedding").alias("array"), F.lit(SAMPLE_RATE).alias("sampling_rate"))
    df = table(spark, sf, "embeddings")
    return df.select((F.col("vec_id") - 1).alias("sample_index"), audio.alias("audio"))


RECORDINGS_SQL = """
recordings AS (
  SELECT vec_id AS sample_index, CASE WHEN label <> 7 THEN CAST(embedding AS DOUBLE[]) END AS wave,
    CASE WHEN label = 3 THEN '' ELSE 'sample ' || vec_id || ' of class ' || label END AS text,
    'voice' || label AS speaker
  FROM embeddings),
made AS (SELECT vec_id - 1 AS sample_index, CAST(embedding AS DOUBLE[]) AS gen_wave FROM embeddings)
"""

PAIRED_SQL = (
    RECORDINGS_SQL
    + """,
paired AS (
  SELECT r.*, m.gen_wave, CASE WHEN r.wave IS NULL THEN 'unsupported_audio'
    WHEN m.gen_wave IS NULL THEN 'not_generated' END AS error
  FROM recordings r LEFT JOIN made m USING (sample_index)
  WHERE r.wave IS NULL OR r.text <> '')
"""
)

COMPARED_SQL = (
    PAIRED_SQL
    + f""",
cut AS (
  SELECT sample_index, {cut_sql("wave", 13)} AS a, {cut_sql("gen_wave", 13)} AS b,
    {pooled_sql(cut_sql("wave", 13))} AS ma, {pooled_sql(cut_sql("gen_wave", 13))} AS mb,
    {pooled_sql(cut_sql("wave", 12))} AS ca, {pooled_sql(cut_sql("gen_wave", 12))} AS cb,
    {pooled_sql(cut_sql("wave", 1))} AS sa, {pooled_sql(cut_sql("gen_wave", 1))} AS sb
  FROM paired WHERE error IS NULL),
{dtw_steps_sql("cut", "sample_index")},
parts AS (
  SELECT sample_index, {cosine_sql("ma", "mb")} AS mfcc_similarity,
    {cosine_sql("ca", "cb")} AS chroma_similarity,
    {cosine_sql("sa", "sb")} AS spectral_centroid_similarity, similarity AS dtw_similarity
  FROM cut JOIN aligned USING (sample_index)),
compared AS (
  SELECT sample_index, {", ".join(f"round({n}, 4) AS {n}" for n in vx.WEIGHTS)},
    round(0.35::DOUBLE * mfcc_similarity + 0.25::DOUBLE * chroma_similarity
      + 0.15::DOUBLE * spectral_centroid_similarity + 0.25::DOUBLE * dtw_similarity, 4) AS overall_score
  FROM parts),
evaluated AS (
  SELECT sample_index, substring(text, 1, 100) AS text, {METRICS_SQL}, error
  FROM paired LEFT JOIN compared USING (sample_index))
"""
)


def features(df: DataFrame) -> DataFrame:
    return encode.extract_features(df.select("sample_index", "audio"), load_reshape_extractor)


def _totals_sql(name: str) -> str:
    return f"list_transform({name}, lambda r: round(list_sum(r), 5)) AS {name}_sums"


@register(
    "extract_features",
    f"""
    WITH {RECORDINGS_SQL}, cut AS (
      SELECT sample_index, wave, {cut_sql("wave", 13)} AS mfcc, {cut_sql("wave", 12)} AS chroma,
        {cut_sql("wave", 1)} AS centroid FROM recordings),
    kept AS (
      SELECT sample_index, wave, {", ".join(f"CASE WHEN wave IS NOT NULL THEN {n} END AS {n}" for n in encode.FEATURES)} FROM cut),
    summed AS (SELECT *, {", ".join(_totals_sql(n) for n in encode.FEATURES)} FROM kept)
    SELECT sample_index, CASE WHEN wave IS NULL THEN 'unsupported_audio' END AS error,
      {", ".join(f"CAST(len({n}[1]) AS INT) AS {n}_frames, CAST(len({n}) AS INT) AS {n}_rows" for n in encode.FEATURES)},
      {", ".join(f"unnest(coalesce({n}_sums, [NULL])) AS {n}_sum" for n in ("mfcc",))},
      unnest(range(0, CASE WHEN wave IS NULL THEN 1 ELSE 13 END)) AS coeff,
      round(list_sum(chroma_sums), 3) AS chroma_sum, round(list_sum(centroid_sums), 3) AS centroid_sum
    FROM summed
    """,
)
def extract_features(spark, sf):
    """Every coefficient row counts: one output row for each of the first feature, sums of the others."""

    def total(row):
        return F.round(F.aggregate(row, F.lit(0.0), lambda acc, v: acc + v), 5)

    found = features(recordings(spark, sf))
    rows = {n: F.get(n, F.lit(0)) for n in encode.FEATURES}
    counted = found.select(
        "sample_index",
        "error",
        *[F.array_size(row).alias(f"{n}_frames") for n, row in rows.items()],
        *[F.array_size(n).alias(f"{n}_rows") for n in encode.FEATURES],
        F.posexplode_outer(F.transform("mfcc", total)).alias("coeff", "mfcc_sum"),
        *[
            F.round(F.aggregate(F.transform(n, total), F.lit(0.0), lambda acc, v: acc + v), 3).alias(f"{n}_sum")
            for n in ("chroma", "centroid")
        ],
    )
    return counted.withColumn("coeff", F.coalesce("coeff", F.lit(0)).cast("bigint"))


@register(
    "long_features",
    f"""
    WITH {RECORDINGS_SQL}, cut AS (
      SELECT sample_index, 'mfcc' AS feature, {cut_sql("wave", 13)} AS matrix FROM recordings WHERE wave IS NOT NULL
      UNION ALL
      SELECT sample_index, 'chroma', {cut_sql("wave", 12)} FROM recordings WHERE wave IS NOT NULL
      UNION ALL
      SELECT sample_index, 'centroid', {cut_sql("wave", 1)} FROM recordings WHERE wave IS NOT NULL),
    coeffs AS (
      SELECT sample_index, feature, CAST(unnest(range(0, len(matrix))) AS INT) AS coeff, unnest(matrix) AS row FROM cut)
    SELECT sample_index, feature, coeff, round(list_sum(row) / len(row), 6) AS pooled FROM coeffs
    """,
)
def long_features(spark, sf):
    """The long feature table, pooled over frames."""
    long = encode.long_features(features(recordings(spark, sf)), sample="sample_index")
    pooled = scoring.mean_pool_long(long, by=["sample_index", "feature", "coeff"])
    return pooled.withColumn("pooled", F.round("pooled", 6))


@register(
    "pair_reference_generated",
    """
    SELECT r.vec_id AS sample_index, r.label, g.label AS gen_label,
           CASE WHEN g.vec_id IS NULL THEN 'not_generated' END AS error
    FROM embeddings r LEFT JOIN embeddings g ON g.vec_id = r.vec_id + 1
    """,
)
def pair_reference_generated(spark, sf):
    df = vectors(spark, sf).select("sample_index", "label")
    return scoring.pair_reference_generated(df, partners(df))


@register(
    "compare_pairs",
    f"WITH RECURSIVE {COMPARED_SQL} SELECT sample_index, {METRICS_SQL} FROM compared",
)
def compare_pairs(spark, sf):
    ref = features(recordings(spark, sf).where("sentence <> ''"))
    paired = scoring.pair_reference_generated(ref, features(generated(spark, sf)))
    return scoring.compare_pairs(paired).where("error IS NULL").select("sample_index", *vx.METRICS)


def _evaluated(spark, sf) -> DataFrame:
    return evaluation.evaluate_pairs(
        recordings(spark, sf), generated(spark, sf), REQUEST, load_reshape_extractor
    )


@register("evaluate_pairs", f"WITH RECURSIVE {COMPARED_SQL} SELECT * FROM evaluated")
def evaluate_pairs(spark, sf):
    return _evaluated(spark, sf)


# Fixed cases by sample index modulo 20: what is done to the features, and the error that follows.
DAMAGES = {
    1: "empty_features",
    2: "unequal_features",
    3: "ragged_features",
    4: "null_features",
    5: "empty_features",
    6: "missing_features",
}
DAMAGED_SQL = """CASE WHEN error IS NOT NULL THEN error ELSE CASE sample_index % 20 {} END END""".format(
    " ".join(f"WHEN {k} THEN '{reason}'" for k, reason in DAMAGES.items())
)


def damaged_features(ref: DataFrame, gen: DataFrame) -> tuple[DataFrame, DataFrame]:
    kind = F.col("sample_index") % 20
    last = F.array_size("mfcc")
    ragged = F.concat(F.slice("mfcc", F.lit(1), last - 1), F.transform(F.slice("mfcc", -1, 1), lambda r: F.slice(r, F.lit(2), F.array_size(r))))
    holed = F.transform("chroma", lambda r: F.transform(r, lambda v, i: F.when(i > 0, v)))
    none = F.array().cast("array<array<double>>")
    ref = ref.withColumns(
        {
            "mfcc": F.when(kind == 3, ragged).otherwise(F.col("mfcc")),
            "chroma": F.when(kind == 4, holed).otherwise(F.col("chroma")),
            "centroid": F.when(kind == 5, F.array(F.array().cast("array<double>"))).otherwise(F.col("centroid")),
        }
    )
    gen = gen.withColumns(
        {
            "mfcc": F.when(kind == 1, none).when(kind == 2, F.slice("mfcc", 1, 12)).otherwise(F.col("mfcc")),
            "chroma": F.when(kind != 6, F.col("chroma")),
        }
    )
    return ref, gen


@register(
    "evaluate_damaged_pairs",
    f"""WITH RECURSIVE {COMPARED_SQL}, judged AS (SELECT *, {DAMAGED_SQL} AS reason FROM evaluated)
    SELECT sample_index, text, {", ".join(f"CASE WHEN reason IS NULL THEN {n} END AS {n}" for n in vx.METRICS)},
           reason AS error FROM judged""",
)
def evaluate_damaged_pairs(spark, sf):
    """Features that cannot be compared fail their own row and no other."""
    ref = evaluation.reference_samples(recordings(spark, sf), REQUEST, load_reshape_extractor)
    ref, gen = damaged_features(ref, features(generated(spark, sf)))
    return scoring.eval_samples(scoring.compare_pairs(scoring.pair_reference_generated(ref, gen)))


@register(
    "dtw_similarity_damaged",
    f"""WITH RECURSIVE {VECTORS_SQL},
    matrices AS (
      SELECT sample_index, {cut_sql("a", 4)} AS a, {cut_sql("b", 4)} AS b FROM vector_pairs),
    {dtw_steps_sql("matrices", "sample_index")}
    SELECT sample_index, CASE WHEN sample_index % 20 NOT IN (1, 2, 3, 4) THEN round(similarity, 4) END AS similarity
    FROM aligned""",
)
def dtw_similarity_damaged(spark, sf):
    """Empty, unequal, ragged and null-holding matrices give null beside their neighbours' scores."""
    kind = F.col("sample_index") % 20
    a = matrix("vec", 4)
    a = (
        F.when(kind == 1, F.array().cast("array<array<double>>"))
        .when(kind == 2, F.slice(a, 1, 3))
        .when(kind == 3, F.concat(F.slice(a, 1, 3), F.array(F.slice("vec", 1, 3))))
        .when(kind == 4, F.transform(a, lambda r: F.transform(r, lambda v, i: F.when(i != 2, v))))
        .otherwise(a)
    )
    scored = vector_pairs(spark, sf).withColumn("similarity", vx.dtw_similarity(a, matrix("gen_vec", 4)))
    return scored.select("sample_index", vx.round_metric("similarity").alias("similarity"))


@register(
    "evaluation_report",
    f"""WITH {PAIRED_SQL}
    SELECT 'completed' AS status, (SELECT count(*) FROM embeddings) AS total, count(*) AS processed,
           CAST(NULL AS VARCHAR) AS error FROM paired""",
)
def evaluation_report(spark, sf):
    return eval_report(recordings(spark, sf), _evaluated(spark, sf))


@register("evaluation_summary", f"WITH RECURSIVE {COMPARED_SQL} {summary_sql('evaluated')}")
def evaluation_summary(spark, sf):
    return scoring.eval_summary(_evaluated(spark, sf))
