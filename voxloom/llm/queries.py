"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import held_out, read
from voxloom.session import scratch_path
from voxloom.llm.codes import books_digest, compress, label_errors
from voxloom.llm.compression import fit_quality, score_quality
from voxloom.llm.jaccard import JaccardJoin, jaccard_classes
from voxloom.llm.langid import fit_language, predict_language
from voxloom.llm.merkle import manifest
from voxloom.llm.mixing import mix
from voxloom.llm.ownership import printed, scan_secrets
from voxloom.llm.pieces import Pieces, decode, encode
from voxloom.llm.syncmers import edited_by_next, fingerprint, likeness, with_anchors
from voxloom.llm.templates import drop_recurring_lines
from voxloom.llm.topk import top_products
from voxloom.llm.toxicity import fit_toxicity, score_toxicity
from voxloom.llm.warc import page_of, read_warc, write_warc

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"  # read on the driver only

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select(
        "row.doc_id",
        held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_windows",
        "top_word",
    )


@_query
def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder, and what the salvage reader finds in them."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = write_warc(pages, scratch_path(spark, "warc"))
    records = read_warc(files, payloads=False).where("reason is null")
    return records.select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        page_of("refers_to").alias("refers_to"),
    )


@_query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal sets, components of links, and the number of links of every document."""
    return jaccard_classes(read(spark, sf_dir, "documents"), JaccardJoin(words=4, percent=85))


@_query
def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding them gives the text back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = Pieces(PIECE_MODEL)
    both = decode(encode(docs, pieces), pieces)
    return both.select(
        "row.doc_id",
        F.size("ids").alias("n_ids"),
        "ids",
        F.col("decoded").eqNullSafe(F.col("row.text")).alias("lossless"),
    )


@_query
def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs).select("row.doc_id", "n_lines", "n_dropped", "text")


@_query
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "size", "source_size", "target", "taken")


@_query
def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_by_next(read(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.select("row", "text", "next_text", "edited", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    found = with_anchors(rows, {"own": "text", "changed": "edited", "other": "next_text"})
    return found.select(
        "row.doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("other")).alias("near_next"),
        F.size("own").alias("n_anchors"),
    )


@_query
def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select(
        "row.doc_id",
        held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "difference",
    )


@_query
def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner, its documents of one language a repository."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = scan_secrets(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    return found.select(
        "row.doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(printed(F.col("base")), 256).alias("base_sha256"),
        printed(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
        "owners",
        "repositories",
        "texts",
    )


@_query
def op9_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_products(vectors, F.col("id") % 100 == 0)


@_query
def op11_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs)
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


@_query
def op12_member_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    coded, books = compress(vectors)
    return label_errors(coded).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


@_query
def op13_merkle_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return manifest(docs)


ORACLES["op9_norm_buckets"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * v.c[i])) AS BIGINT) AS score
  FROM whole q JOIN whole v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLES["op2_warc_salvage"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
  SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < head THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
"""

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op3_jaccard_join"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(first_id, doc_id)) AS component_id,
       CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS class_id,
       coalesce(n, 0) AS n_links
FROM sets LEFT JOIN (SELECT x, min(y) AS first_id FROM reach GROUP BY x) r ON r.x = doc_id
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = doc_id
"""

ORACLES["op10_source_mix"] = f"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         CAST('0x' || substring(md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(text))), 1, 15) AS BIGINT) AS h
  FROM documents
), total AS (
  SELECT CAST(sum(size) AS BIGINT) AS s FROM docs
), names AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM docs GROUP BY source
), weighed AS (
  SELECT *, CAST(sid % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM names
), judged AS (
  SELECT weighed.*, s, cap * sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (s - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS stops
  FROM weighed, total
), aimed AS (
  SELECT *, CASE WHEN stops THEN cap ELSE w * (s - coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0))
    / sum(CASE WHEN NOT stops THEN w END) OVER () END AS target FROM judged
), ends AS (
  SELECT source, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words FROM aimed
), grouped AS (
  SELECT source, h, size, count(*) AS m FROM docs GROUP BY ALL
), placed AS (
  SELECT *, coalesce(sum(m * size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM grouped
)
SELECT doc_id, docs.size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE docs.size * (words // source_size)
    + greatest(0, least(words % source_size - used, m * docs.size)) // m END AS BIGINT) AS taken
FROM docs JOIN ends ON docs.source IS NOT DISTINCT FROM ends.source
JOIN placed ON docs.source IS NOT DISTINCT FROM placed.source AND docs.h = placed.h AND docs.size = placed.size
"""


def _rounds(n: int) -> str:
    """The CTEs of ``n`` rounds: ``a<k>`` assigns to the books ``b<k-1>``, ``b<k>`` are the books after it."""
    out = []
    for k in range(1, n + 1):
        out.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, p, min(d * 16 + k) % 16 AS k FROM (
    SELECT parts.r, parts.p, b.k, list_sum(list_transform(list_zip(parts.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts JOIN b{k - 1} b ON parts.p = b.p
  ) GROUP BY r, p
), m{k} AS (
  SELECT p, k, list(m ORDER BY j) AS c FROM (
    SELECT p, k, j, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (
      SELECT p, k, unnest(c) AS x, generate_subscripts(c, 1) AS j FROM parts JOIN a{k} USING (r, p)
    ) GROUP BY p, k, j
  ) GROUP BY p, k
), b{k} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM b{k - 1} b LEFT JOIN m{k} m ON b.p = m.p AND b.k = m.k
),""")
    return "".join(out)


ORACLES["op12_member_lloyd"] = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, vec_id, label, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS c
  FROM kept, LATERAL (SELECT unnest(range(0, 8)) AS p)
), b0 AS MATERIALIZED (
  SELECT p, k, c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, c FROM parts) WHERE k < 16
),{_rounds(6)}
best AS (
  SELECT r, p, min(d * 16 + k) AS dk FROM (
    SELECT parts.r, parts.p, b.k, list_sum(list_transform(list_zip(parts.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts JOIN b6 b ON parts.p = b.p
  ) GROUP BY r, p
), coded AS (
  SELECT r, string_agg(printf('%02x', CAST(dk % 16 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(dk // 16) AS BIGINT) AS error FROM best GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b6
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), books
"""

ORACLES["op13_merkle_rollup"] = f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(range(0, 8), lambda c, j: xor(c >> 1, (c & 1) * 3988292384), i) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)
), fields AS (
  SELECT *, {" || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang"))} AS before,
    coalesce(strlen(text) || ':' || text, '-') AS after, coalesce('=' || lang, '') AS g,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc
), hashed AS (
  SELECT g, doc_id, sha256(before || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || after) AS leaf,
    sha256(before || coalesce(strlen(CAST(n_chars + CAST(tampered AS INT) AS VARCHAR)) || ':' || (n_chars + CAST(tampered AS INT)), '-') || after) AS used
  FROM fields
), docs AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS r FROM hashed
), levels AS (
  SELECT g, 0 AS level, list(leaf ORDER BY i) AS h FROM docs GROUP BY g
  UNION ALL
  SELECT g, level + 1, list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')))
  FROM levels WHERE len(h) > 1
), subroots AS MATERIALIZED (
  SELECT g, h[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM levels WHERE len(h) = 1
), uppers AS (
  SELECT 0 AS level, list(subroot ORDER BY i) AS h FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')))
  FROM uppers WHERE len(h) > 1
), nodes AS MATERIALIZED (
  SELECT g, level, unnest(h) AS hash, generate_subscripts(h, 1) - 1 AS i FROM levels WHERE len(h) > 1
), tops AS MATERIALIZED (
  SELECT level, unnest(h) AS hash, generate_subscripts(h, 1) - 1 AS i FROM uppers WHERE len(h) > 1
), steps AS (
  SELECT r, l.level, CASE WHEN (d.i >> l.level) & 1 = 1 THEN n.hash || '|' ELSE '|' || coalesce(n.hash, '') END AS step
  FROM docs d JOIN (SELECT DISTINCT g, level FROM nodes) l ON l.g = d.g
  LEFT JOIN nodes n ON n.g = d.g AND n.level = l.level AND n.i = xor(d.i >> l.level, 1)
  UNION ALL
  SELECT r, 1000 + l.level, CASE WHEN (s.i >> l.level) & 1 = 1 THEN n.hash || '|' ELSE '|' || coalesce(n.hash, '') END
  FROM docs d JOIN subroots s ON s.g = d.g, (SELECT DISTINCT level FROM tops) l
  LEFT JOIN tops n ON n.level = l.level AND n.i = xor(s.i >> l.level, 1)
), paths AS (
  SELECT r, list(step ORDER BY level) AS path FROM steps GROUP BY r
), folded AS (
  SELECT doc_id, leaf, subroot, (SELECT h[1] FROM uppers WHERE len(h) = 1) AS root,
    sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
    list_reduce(coalesce(path, []), lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2)), used) AS folded_root
  FROM docs d JOIN subroots s ON s.g = d.g LEFT JOIN paths p ON p.r = d.r
)
SELECT *, folded_root = root AS verified FROM folded
"""
