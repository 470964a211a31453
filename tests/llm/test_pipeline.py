"""The pipeline stage by stage, next to what each stage must do, on a small fixture."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from llm_texts import prose
from pyspark.sql import functions as F

import corpus_pipeline as cp
from voxloom.llm.pieces import Pieces, decode_ids
from voxloom.llm.queries import ORACLES, PIECE_MODEL, QUERIES

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "row", "score"]


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    texts, toxic = [], {}
    for i in range(150):
        words = prose(i, 40).split()
        if i % 3 == 0:
            words[10] = words[20] = words[30] = ["grumble", "grumbling", "grumbler"][i // 3 % 3]
        texts.append(" ".join(words))
        toxic[i] = int(i % 3 == 0)
    base = prose(900, 120).split()
    for k in range(6):  # near copies without line ends
        texts.append(" ".join(base[: 100 + k] + [f"new{k}"]))
    texts += [texts[1], texts[2], None, "", f"{prose(950, 30)}\n{prose(951, 60)}", f"{prose(952, 30)}\n{prose(951, 60)}"]
    root = str(tmp_path_factory.mktemp("tables"))
    ids = [*range(len(texts))]
    documents(texts, ids, [["a", "b", None][i % 3] for i in ids]).write.parquet(f"{root}/documents.parquet")
    rows = [(i, 1, toxic[i]) for i in toxic]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, folder):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "pieces"]
    stages = dict(cp.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    all_rows = {r.doc_id: r for r in docs.collect()}

    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == COLUMNS
    kept = {r.doc_id: r for r in clean.collect()}
    bad = {i for i, r in all_rows.items() if "grumbl" in (r.text or "")}
    assert len(bad & set(kept)) <= 2 and len(set(all_rows) - bad - set(kept)) <= 3
    assert all(kept[i] == all_rows[i] for i in kept)

    docs = spark.createDataFrame([all_rows[i] for i in all_rows if i not in bad], docs.schema)
    lines = stages["line_dedup"](spark, docs, folder)
    assert lines.columns == COLUMNS
    left = {r.doc_id: r for r in lines.collect()}
    # Exact copies have no line of their own left; the passage stays in the first document that has it.
    assert set(left) == set(all_rows) - bad - {156, 157}
    assert left[160].text == all_rows[160].text and left[161].text == prose(952, 30) and left[161].n_chars == len(prose(952, 30))
    assert left[158].text is None and left[159].text == ""

    single = stages["near_duplicates"](spark, docs, folder)
    assert single.columns == COLUMNS
    found = [r.doc_id for r in single.collect()]
    assert len(found) == len(set(found))
    assert set(found) >= {1, 2, 150, 158, 159, 160, 161} and not set(found) & {151, 152, 153, 154, 155, 156, 157}
    twice = stages["near_duplicates"](spark, docs.union(docs), folder)
    assert sorted(r.doc_id for r in twice.collect()) == sorted([*found, 158, 159])  # no words: nothing to compare

    mixed = stages["mixing"](spark, single, folder)
    assert mixed.columns == COLUMNS
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert words["a"] < words["b"] < words[None]

    ids = stages["pieces"](spark, mixed, folder)
    pieces = Pieces(PIECE_MODEL)
    assert all(decode_ids(pieces, r.ids) == (all_rows[r.doc_id].text) for r in ids.collect())
    assert ids.count() == mixed.count()


def test_stages_do_not_depend_on_ansi_mode(spark, folder):
    """Null and empty texts stay, and nothing else changes, whatever the size of a null array is."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 100")
    stages = dict(cp.STAGES)

    def found(ansi):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            return [sorted(map(str, stages[n](spark, docs, folder).collect())) for n in ("line_dedup", "near_duplicates", "mixing")]
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")

    strict, lax = found("true"), found("false")
    assert strict == lax
    assert sum("text=None" in r for r in lax[0]) == 1 and sum("text=''" in r for r in lax[0]) == 1


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert cp.run(spark, folder).columns == ["doc_id", "source", "ids"]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_registered_queries():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)


def test_the_library_works_without_the_operators(tmp_path):
    """A copy without this package, the pipeline and these tests still offers all other queries."""
    import shutil

    ignore = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(REPO, tmp_path / "copy", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'build_training_set' in q and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_near_duplicates_without_ids_or_broadcasts(spark, documents, monkeypatch):
    from collections import Counter

    import corpus_pipeline as cp
    from llm_texts import prose

    texts = [prose(i % 7, 80 + i % 7) for i in range(28)] + ["", None, ""]
    docs = documents(texts, [None if i % 3 == 0 else i for i in range(31)])
    docs = docs.unionByName(docs.where("doc_id in (1, 2)"))

    def kept():
        return Counter((r.doc_id, r.text) for r in cp.remove_near_duplicates(spark, docs, "").collect())

    want = kept()
    # Of each text the smallest id stays, and one row without any.
    assert all(n == 1 for n in want.values())
    assert {t for _, t in want} == set(texts)
    pick = cp.pick_rows
    monkeypatch.setattr(cp, "pick_rows", lambda *a, **k: pick(*a, **k, bound=0))
    assert kept() == want


def test_blocks_of_text_take_little_memory():
    """A worker of the first and of the last stage holds one block's arrays at a time."""
    import tracemalloc

    import numpy as np

    from voxloom.llm import pieces, toxicity
    from voxloom.llm.queries import PIECE_MODEL

    model = pieces.Pieces(PIECE_MODEL)
    weights = toxicity.start_weights(toxicity.ToxicityModel()) | {"calibration": np.zeros(3)}
    line = " ".join(f"word{i % 997} of{i % 89}" for i in range(200))

    def peak(job, block):
        texts = [line] * (1 + block // len(line))
        job(texts[:2])
        tracemalloc.start()
        job(texts)
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found

    assert peak(lambda t: pieces.encode_texts(model, t, np.arange(len(t), dtype=np.uint64), 0.1), pieces.BLOCK_BYTES) < 25_000_000
    assert peak(lambda t: toxicity.score_texts(weights, t), toxicity.BLOCK_BYTES) < 8_000_000
