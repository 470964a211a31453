from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.llm.common import perhaps_in, salted_join
from voxloom.llm.templates import TemplateTree, drop_recurring_lines, line_tokens

LICENSE = "This work is licensed under the GNU General Public License, version 3."
PASSAGE = " ".join(f"word{chr(97 + i % 26)}x" for i in range(60))


def kept(documents, texts, ids=None, how=TemplateTree()):
    out = drop_recurring_lines(documents(texts, ids), how)
    assert out.schema["row"].dataType.names == ["doc_id", "lang", "source", "n_chars", "row", "score"]
    return [(r.row.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]


def test_exact_lines_stay_in_the_first_document(documents):
    texts = [f"own a b c d e\n{LICENSE}", f"{LICENSE}\nshort line\nother own a b c d", f"short line\n{PASSAGE}\n{LICENSE}", f"{PASSAGE}"]
    got = {i: t for i, t, *_ in kept(documents, texts, [7, 3, 5, 9])}
    assert got == {7: "own a b c d e", 3: texts[1], 5: f"short line\n{PASSAGE}", 9: ""}


def test_fields_with_digits_are_variable(documents):
    assert line_tokens("user 42 at 10.0.0.1  ok") == ["user", "<*>", "at", "<*>", "ok"]
    texts = [f"user {i}x{i} logged in from 10.0.0.{i} at noon" for i in range(4)]
    assert [t for _, t, *_ in sorted(kept(documents, texts))] == [texts[0], "", "", ""]


def test_leaves_generalise_what_varies(documents):
    names = ["anna", "boris", "carla", "dmitri", "eva", "frank"]
    texts = [f"the nightly backup of server {n} finished without errors today" for n in names]
    # The name stands behind the leading tokens; all other tokens are constant.
    assert [t for _, t, *_ in sorted(kept(documents, texts))] == [texts[0], "", "", "", "", ""]
    # Fewer documents than a template needs: every line is its own.
    assert [t for _, t, *_ in sorted(kept(documents, texts[:4]))] == texts[:4]
    # Prose that shares its first words and its length, but little else, has no template.
    prose = [" ".join(["in", "the", "end", *[f"{a}{b}" for b in "klmnopq"]]) for a in "abcdef"]
    assert [t for _, t, *_ in sorted(kept(documents, prose))] == prose


def test_odd_rows(documents, odd_texts):
    texts = [*odd_texts, LICENSE, LICENSE, LICENSE]
    ids = [*range(len(odd_texts)), None, 50, 50]  # no id; a row that repeats
    got = kept(documents, texts, ids)
    by_id = {}
    for i, t, n, d in got:
        by_id.setdefault(i, []).append((t, n, d))
    assert by_id[50] == [(LICENSE, 1, 0)] * 2  # one document: its copies keep the same lines
    assert by_id[None] == [("", 1, 1)]  # rows without an id come last
    assert by_id[0] == [(None, 0, 0)] and by_id[1] == [("", 1, 0)]
    assert by_id[6][0][0] == odd_texts[6] and by_id[7] == [("", 1, 1)]  # equal texts: the first stays
    assert by_id[10][0][0] == odd_texts[10]
    assert kept(documents, []) == []


def test_a_line_may_repeat_inside_a_document(documents):
    text = f"{LICENSE}\n{LICENSE}\nx"
    assert sorted(kept(documents, [text, text])) == [(0, text, 3, 0), (1, "x", 3, 2)]


def test_short_lines_go_where_many_documents_share_them(documents):
    short = ["All rights reserved.", "版权所有翻印必究", "https://example.org/terms"]
    texts = ["\n".join([f"own line of number {chr(97 + i) * 4}", "", *short]) for i in range(5)]
    got = [t for _, t, *_ in sorted(kept(documents, texts))]
    assert got == [texts[0], *(f"own line of number {chr(97 + i) * 4}\n" for i in range(1, 5))]  # blank lines stay
    assert [t for _, t, *_ in sorted(kept(documents, texts[:4]))] == texts[:4]
    # Short lines are not masked: numbers part them.
    years = [f"Copyright {1990 + i} us" for i in range(8)]
    assert [t for _, t, *_ in sorted(kept(documents, years))] == years


def test_rows_of_numbers_are_no_copies(documents):
    texts = ["1 2 3 4 5 6", "7 8 9 10 11 12", "total of 1 2 3 4 5 6", "total of 9 8 7 6 5 4", "7 8  9 10 11 12"]
    assert [t for _, t, *_ in sorted(kept(documents, texts))] == [*texts[:4], ""]
    many = [" ".join(str(100 * i + k) for k in range(8)) for i in range(9)]
    assert [t for _, t, *_ in sorted(kept(documents, many))] == many


def test_what_is_broadcast_does_not_grow_with_the_lines(spark, documents, monkeypatch):
    sizes = []
    monkeypatch.setattr(F, "broadcast", lambda df, real=F.broadcast: (sizes.append(df.count()), real(df))[1])
    names = [a + b + c for a in "abcdefghijklmnopqrst" for b in "klmnopqrstuvwxyz" for c in "uvwxyz"]
    lines = [f"the nightly backup of server {n} finished without errors today" for n in names]
    texts = ["\n".join(lines[k : k + 4]) for k in range(0, len(lines), 4)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(kept(documents, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # All lines are wanted, and one template; the first document keeps its lines.
    assert [t for _, t, *_ in got] == [texts[0], *[""] * (len(texts) - 1)]
    assert max(sizes) < 1000 < len(lines)


def test_a_filter_of_keys_loses_none(spark):
    keys = spark.range(0, 40_000, 7).select((F.xxhash64("id")).alias("k"))
    rows = spark.range(40_000).withColumn("h", F.xxhash64("id"))
    kept_ids = {r.id for r in perhaps_in(rows, F.col("h"), keys, "k").select("id").collect()}
    assert kept_ids >= set(range(0, 40_000, 7)) and len(kept_ids) < 6_000
    assert perhaps_in(rows, F.col("h"), keys.limit(0), "k").count() == 0


def test_salted_copies_of_a_small_file_are_not_broadcast(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    small, large = spark.read.parquet(str(tmp_path / "t")), spark.range(1000)
    joined = salted_join(large, small, "id", "inner", spread=F.xxhash64("id"), merge=True)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100
