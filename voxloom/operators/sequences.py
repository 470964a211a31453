"""Training sequences from text and codes, and codes back from sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import frames as fx
from voxloom.functions import sequences as sx
from voxloom.functions import text as tx
from voxloom.functions.arrays import INT_ARRAY, int_array
from voxloom.vocab import DEFAULT_LAYOUT, LAYERS, TRAINING_COLUMNS, TokenLayout


def _speaker(df: DataFrame, column: str) -> Column | None:
    return F.col(column) if column in df.columns else None


def tokenize_text(
    df: DataFrame,
    tokenizer: tx.Tokenizer | None = None,
    *,
    speaker_id: str | None = None,
    text: str = "text",
    speaker: str = "speaker",
    layout: TokenLayout = DEFAULT_LAYOUT,
    into: str = "text_tokens",
) -> DataFrame:
    """Speaker prompt as ids, closed by the end-of-text marker."""
    tokenizer = tokenizer or tx.char_tokenizer(layout=layout)
    prompt = tx.speaker_prompt(text, _speaker(df, speaker), speaker_id)
    return df.withColumn(into, F.concat(tokenizer(prompt), int_array([layout.end_of_text])))


def build_input_ids(df: DataFrame, layout: TokenLayout = DEFAULT_LAYOUT) -> DataFrame:
    return df.withColumn("input_ids", sx.input_ids("text_tokens", "codes_list", layout))


def add_training_columns(df: DataFrame, layout: TokenLayout = DEFAULT_LAYOUT) -> DataFrame:
    """All four training columns from ``text_tokens``, ``codes_list`` and ``num_audio_frames``."""
    positions = sx.frame_position_ids(sx.prefix_length("text_tokens"), "num_audio_frames", layout)
    return (
        build_input_ids(df, layout)
        .withColumn("position_ids", positions)
        .withColumn("labels", F.col("input_ids"))
        .withColumn("attention_mask", sx.ones_like("input_ids"))
    )


def training_projection(df: DataFrame, *keep: str) -> DataFrame:
    """Only the training columns, after any key columns named in ``keep``."""
    return df.select(*keep, *TRAINING_COLUMNS)


def prompt_sequence(
    df: DataFrame,
    tokenizer: tx.Tokenizer | None = None,
    *,
    speaker_id: str | None = None,
    text: str = "text",
    speaker: str = "speaker",
    layout: TokenLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Inference prompt with its mask and positions."""
    tokenizer = tokenizer or tx.char_tokenizer(layout=layout)
    prompt = tx.speaker_prompt(text, _speaker(df, speaker), speaker_id)
    return (
        df.withColumn("input_ids", sx.prompt_ids(tokenizer(prompt), layout))
        .withColumn("attention_mask", sx.ones_like("input_ids"))
        .withColumn("position_ids", sx.plain_positions("input_ids"))
    )


def rebuild_positions(
    df: DataFrame, *, ids: str = "ids", into: str = "position_ids", layout: TokenLayout = DEFAULT_LAYOUT
) -> DataFrame:
    return df.withColumn(into, sx.rebuild_positions(ids, layout))


def validate_markers(
    df: DataFrame, *, ids: str = "ids", into: str = "error", layout: TokenLayout = DEFAULT_LAYOUT
) -> DataFrame:
    """``missing_marker`` unless both speech markers are present."""
    return df.withColumn(
        into, F.when(~F.coalesce(sx.has_markers(ids, layout), F.lit(False)), F.lit("missing_marker"))
    )


def deinterleave_codes(
    df: DataFrame,
    *,
    ids: str = "ids",
    strict: bool = False,
    error: str = "error",
    layout: TokenLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Four codec layers back from a token sequence, or the reason there are none.

    Errors: ``missing_marker``, ``ambiguous_marker``, ``bad_order``,
    ``partial_frame``, ``negative_code`` and, with ``strict``, ``code_overflow``.
    An empty audio region gives four empty layers.
    """
    width = layout.codebooks
    marked = df.withColumn(error, sx.marker_error(ids, layout)).withColumn(
        "_audio", F.when(F.col(error).isNull(), sx.audio_region(ids, layout))
    )
    layered = marked.withColumns(
        {
            name: F.when(F.array_size("_audio") % width == 0, fx.deinterleave("_audio", k, layout))
            for k, name in enumerate(LAYERS)
        }
    )
    lowest = F.least(*[F.coalesce(F.array_min(name), F.lit(0)) for name in LAYERS])
    highest = F.greatest(*[F.coalesce(F.array_max(name), F.lit(0)) for name in LAYERS])
    reason = (
        F.when(F.col(error).isNotNull(), F.col(error))
        .when(F.array_size("_audio") % width != 0, F.lit("partial_frame"))
        .when(lowest < 0, F.lit("negative_code"))
    )
    if strict:
        reason = reason.when(highest >= layout.codebook_size, F.lit("code_overflow"))
    checked = layered.withColumn(error, reason)
    return checked.withColumns(
        {name: F.when(F.col(error).isNull(), F.col(name)).cast(INT_ARRAY) for name in LAYERS}
    ).drop("_audio")


def extract_text_span(
    df: DataFrame,
    *,
    ids: str = "ids",
    into: str = "text_tokens",
    decode_into: str | None = "text",
    detokenizer: tx.Detokenizer | None = None,
    layout: TokenLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Text tokens with their markers, and the text that they spell without them.

    ``detokenizer`` belongs to the tokenizer that made the sequences; without one
    ids are characters.  Ids that spell no text give null and leave other rows alone.

    The span comes out of a one-element ``inline``: the optimizer moves whatever a Python
    function needs into its argument, and all steps that make the ids would be repeated there.
    """
    span = F.inline(F.array(F.struct(sx.text_span(ids, layout).alias(into))))
    columns = df.columns if into in df.columns else [*df.columns, into]
    spanned = df.select(*[c for c in df.columns if c != into], span).select(*columns)
    if decode_into is None:
        return spanned
    inner = F.array_remove(F.array_remove(F.col(into), layout.start_of_text), layout.end_of_text)
    return spanned.withColumn(decode_into, (detokenizer or tx.char_detokenizer())(inner))
