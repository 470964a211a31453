"""Hand-computed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.arrays import int_array
from voxloom.operators import batching, frames, sequences
from voxloom.plans import decoding, training
from voxloom.vocab import DEFAULT_LAYOUT, LAYERS, TokenLayout

GOLDEN_IDS = [
    64403, 1, 10, 11, 2, 64404, 64405, 64401,
    64415, 68443, 72476, 76509, 64417, 68443, 72476, 76509,
    64402, 64406,
]
GOLDEN_POSITIONS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 8, 9, 9, 9, 9, 10, 11]

ROW_SCHEMA = "row_key string, " + ", ".join(f"{n} array<int>" for n in LAYERS) + (
    ", encoded_len int, text string, speaker string"
)


def golden_row(spark):
    return spark.createDataFrame(
        [("r", [5, 5, 7], [1, 1, 1], [2, 2, 2], [3, 3, 3], 3, "ignored", None)], ROW_SCHEMA
    )


def test_layout():
    assert DEFAULT_LAYOUT.pad == 64407
    assert [DEFAULT_LAYOUT.codebook_start(k) for k in range(4)] == [64410, 68442, 72474, 76506]
    small = TokenLayout(text_vocab=100, codebook_size=8)
    assert (small.start_of_speech, small.end_of_ai, small.codebook_start(3)) == (101, 106, 134)


def test_build(spark):
    built = training.build_rows(golden_row(spark), tokenizer=lambda text: int_array([1, 10, 11])).first()
    assert built.input_ids == GOLDEN_IDS
    assert built.labels == GOLDEN_IDS
    assert built.position_ids == GOLDEN_POSITIONS
    assert built.attention_mask == [1] * len(GOLDEN_IDS)


def test_dedup_compares_with_the_original_predecessor(spark):
    rows = [("r", [1, 1, 2, 1, 1], [0] * 5, [0] * 5, [0, 0, 0, 0, 9], 5, "", None)]
    framed = frames.add_frames(spark.createDataFrame(rows, ROW_SCHEMA)).first().frames
    assert [(f[0], f[3]) for f in framed] == [(1, 0), (2, 0), (1, 0), (1, 9)]


def test_dedup_of_nothing(spark):
    rows = [("r", [], [], [], [], 0, "", None)]
    coded = frames.add_codes(frames.add_frames(spark.createDataFrame(rows, ROW_SCHEMA))).first()
    assert (coded.codes_list, coded.num_audio_frames) == ([], 0)


def test_pad(spark):
    rows = [(0, [1, 2, 3], [1, 2, 3], [1, 1, 1], [0, 1, 2]), (0, [4, 5], [4, 5], [1, 1], [0, 1])]
    schema = "batch_id long, input_ids array<int>, labels array<int>, attention_mask array<int>, position_ids array<int>"
    padded = {r.input_ids[0]: r for r in batching.pad_batch(spark.createDataFrame(rows, schema)).collect()}
    assert padded[1].input_ids == [1, 2, 3]
    short = padded[4]
    assert short.input_ids == [4, 5, 64407]
    assert short.labels == [4, 5, -100]
    assert short.attention_mask == [1, 1, 0]
    assert short.position_ids == [0, 1, 0]


def decode(spark, ids, **options):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    return decoding.decode_sequences(df, with_text=False, **options).first()


S, E, A = 64401, 64402, [64415, 68443, 72476, 76509]


def test_decode_errors(spark):
    cases = {
        "missing_marker": [1, 2, *A, E],
        "bad_order": [E, *A, S],
        "partial_frame": [S, *A[:3], E],
        "ambiguous_marker": [S, S, *A, E],
        "negative_code": [S, A[1], A[0], A[2], A[3], E],
    }
    for reason, ids in cases.items():
        row = decode(spark, ids)
        assert row.error == reason, ids
        assert row.nano_layer_1 is None
    assert decode(spark, None).error == "missing_marker"


def test_decode_sound_and_empty(spark):
    row = decode(spark, GOLDEN_IDS)
    assert row.error is None
    assert [row[n] for n in LAYERS] == [[5, 7], [1, 1], [2, 2], [3, 3]]
    assert row.num_frames == 2
    assert row.position_ids == GOLDEN_POSITIONS
    empty = decode(spark, [9, S, E])
    assert empty.error is None
    assert [empty[n] for n in LAYERS] == [[], [], [], []]


def test_code_overflow_only_when_strict(spark):
    ids = [S, *A[:3], 99999, E]
    assert decode(spark, ids).error is None
    assert decode(spark, ids, strict=True).error == "code_overflow"


def test_text_marker_error_comes_last(spark):
    def error(ids):
        df = spark.createDataFrame([(ids,)], "ids array<int>")
        return decoding.decode_sequences(df).first().error

    assert error([1, 5, 2, S, *A, E]) is None
    assert error([1, 1, 5, 2, S, *A, E]) == "text_marker"
    assert error([1, 1, 5, 2, S, *A]) == "missing_marker"


def test_rebuild_positions_edges(spark):
    def positions(ids):
        df = spark.createDataFrame([(ids,)], "ids array<int>")
        return sequences.rebuild_positions(df).first().position_ids

    assert positions([7, 8, 9]) == [0, 1, 2]
    assert positions([7, S, *A, 50]) == [0, 1, 2, 2, 2, 2, 3]
    assert positions([7, S, *A, 50, E, 9]) == [0, 1, 2, 2, 2, 2, 3, 4, 5]
    assert positions([7, S, E, 9]) == [0, 1, 2, 3]
    assert positions([E, S, *A]) is None
    assert positions([]) == []


def test_prompt(spark):
    df = spark.createDataFrame([("ab", "Bo"), ("", None)], "text string, speaker string")
    first, second = sequences.prompt_sequence(df).collect()
    chars = [3 + ord(c) for c in "bo: ab"]
    assert first.input_ids == [64403, 1, *chars, 2, 64404]
    assert first.position_ids == list(range(len(first.input_ids)))
    assert second.input_ids == [64403, 1, 2, 64404]


def test_text_round_trip(spark):
    text = "Čaj, naïve 中文 ñ"
    df = spark.createDataFrame([(text,)], "text string")
    ids = sequences.tokenize_text(df).withColumnRenamed("text_tokens", "ids").drop("text")
    span = sequences.extract_text_span(ids).first()
    assert span.text == text
    assert span.text_tokens[0] == 1 and span.text_tokens[-1] == 2


def test_long_form_of_lengths(spark):
    parts = training.build_parts(golden_row(spark))
    from voxloom.functions.sequences import sequence_length

    built = sequences.add_training_columns(parts).withColumn(
        "n", sequence_length("text_tokens", "num_audio_frames")
    )
    assert built.where(F.col("n") != F.size("input_ids")).count() == 0
