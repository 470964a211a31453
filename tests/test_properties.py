"""Properties over generated rows."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.functions import vectors as vx
from voxloom.operators import batching, sequences
from voxloom.plans import decoding, training
from voxloom.vocab import LAYERS, TRAINING_COLUMNS

SCHEMA = "row_key string, " + ", ".join(f"{n} array<int>" for n in LAYERS) + (
    ", encoded_len int, text string, speaker string"
)

frame = st.tuples(*[st.integers(0, 4031)] * 4)
runs = st.lists(st.tuples(frame, st.integers(1, 3)), min_size=1, max_size=12)
# below the code point where the stand-in tokenizer folds characters
text = st.text(st.characters(max_codepoint=0xD7FF, exclude_categories=["Cs", "Cc"]), max_size=20)
row = st.tuples(runs, text, st.one_of(st.none(), text))


def encoded_rows(spark, rows):
    made = []
    for i, (frames, said, who) in enumerate(rows):
        flat = [f for f, n in frames for _ in range(n)]
        made.append((str(i), *[[f[k] for f in flat] for k in range(4)], len(flat), said, who))
    return spark.createDataFrame(made, SCHEMA), made


def squeeze(frames):
    return [f for i, f in enumerate(frames) if i == 0 or f != frames[i - 1]]


@settings(max_examples=12, deadline=None)
@given(st.lists(row, min_size=1, max_size=8))
def test_build_and_decode(spark, rows):
    df, made = encoded_rows(spark, rows)
    sound = training.sound_rows(df, max_seconds=30)
    built = training.build_rows(sound).withColumnRenamed("input_ids", "ids")
    out = decoding.decode_sequences(
        built.withColumnRenamed("position_ids", "built_positions"), ids="ids"
    ).collect()
    assert len(out) == len(made)
    for r in out:
        source = made[int(r.row_key)]
        kept = squeeze(list(zip(*source[1:5])))
        assert r.error is None
        # decoding gives the deduplicated layers back
        assert list(zip(*[r[n] for n in LAYERS])) == kept
        # positions from the ids alone equal those of the build
        assert r.position_ids == r.built_positions
        assert len({len(r[c]) for c in ("ids", "labels", "attention_mask", "built_positions")}) == 1
        prefix = r.ids.index(64401) + 1
        assert max(r.built_positions) == prefix + len(kept) + 1
        assert r.built_positions == sorted(r.built_positions)
        said, who = source[6], source[7]
        if who is None:
            assert r.text == said
        elif who.isascii():
            assert r.text == f"{who.lower()}: {said}"


@settings(max_examples=8, deadline=None)
@given(st.lists(row, min_size=1, max_size=10), st.integers(1, 5), st.integers(1, 6))
def test_batches_hold_the_training_rows(spark, rows, size, buckets):
    df, made = encoded_rows(spark, rows)
    options = {"max_seconds": 30}
    plain = {r.row_key: r for r in training.training_set([(df, None)], **options).collect()}
    padded = training.batches([(df, None)], batch_size=size, buckets=buckets, **options).collect()
    stored = batching.assign_batches(
        training.training_set([(df, None)], **options), key=training.ROW_KEY, batch_size=size
    )
    two_step = {r.row_key: r for r in batching.pad_batch(stored).collect()}
    assert sorted(r.row_key for r in padded) == sorted(plain)
    for r in padded:
        n = len(plain[r.row_key].input_ids)
        for c in TRAINING_COLUMNS:
            assert r[c][:n] == plain[r.row_key][c]
            assert r[c] == two_step[r.row_key][c]
        assert r.batch_id == two_step[r.row_key].batch_id
    for b in {r.batch_id for r in padded}:
        assert len({len(r.input_ids) for r in padded if r.batch_id == b}) == 1


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(64395, 64420), max_size=30))
def test_rebuilt_positions_follow_the_rules(spark, ids):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    got = sequences.rebuild_positions(df).first().position_ids
    if 64401 not in ids:
        assert got == list(range(len(ids)))
        return
    start = ids.index(64401) + 1
    end = ids.index(64402) if 64402 in ids else len(ids)
    if end < start:
        assert got is None
        return
    want = []
    for i in range(len(ids)):
        if i < start:
            want.append(i)
        elif i < end:
            want.append(start + (i - start) // 4)
        else:
            want.append(start + -(-(end - start) // 4) + i - end)
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_similarity_of_a_thing_with_itself(spark, seed):
    m = np.random.default_rng(seed).normal(size=(13, 6)).tolist()
    df = spark.createDataFrame([(m,)], "m array<array<double>>")
    r = df.select(
        vx.dtw_similarity("m", "m").alias("d"),
        F.round(vx.cosine_similarity(vx.mean_pool("m"), vx.mean_pool("m")), 12).alias("c"),
    ).first()
    assert (r.d, r.c) == (1.0, 1.0)
