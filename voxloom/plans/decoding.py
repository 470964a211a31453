"""Generated token sequences to codec layers, text and positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import Detokenizer
from voxloom.operators.encode import CodecDecoder, decode_audio
from voxloom.operators.sequences import deinterleave_codes, extract_text_span, rebuild_positions
from voxloom.vocab import DEFAULT_LAYOUT, LAYERS, TokenLayout


def decode_sequences(
    df: DataFrame,
    *,
    ids: str = "ids",
    with_text: bool = True,
    strict: bool = False,
    detokenizer: Detokenizer | None = None,
    layout: TokenLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Validate and decode token sequences, one row each.

    Adds the four layers, ``num_frames``, ``position_ids``, ``text`` and
    ``error``.  With text, a sequence whose text markers do not occur exactly
    once is an error (``text_marker``), after all audio errors, and so is one whose
    text ids spell no text (``bad_text``).
    """
    out = deinterleave_codes(df, ids=ids, strict=strict, layout=layout)
    if with_text:
        out = extract_text_span(out, ids=ids, detokenizer=detokenizer, layout=layout)
        fault = F.when(F.col("text_tokens").isNull(), F.lit("text_marker")).when(F.col("text").isNull(), F.lit("bad_text"))
        out = out.withColumn("error", F.coalesce("error", fault))
    sound = F.col("error").isNull()
    blank = [*LAYERS, "text", "text_tokens"] if with_text else [*LAYERS]
    out = out.withColumns({c: F.when(sound, F.col(c)) for c in blank})
    out = out.withColumn("num_frames", F.when(sound, F.array_size(LAYERS[0])))
    return rebuild_positions(out, ids=ids, layout=layout)


def decode_waveforms(
    df: DataFrame,
    load_decoder: Callable[[], CodecDecoder],
    *,
    ids: str = "ids",
    with_text: bool = True,
    strict: bool = False,
    detokenizer: Detokenizer | None = None,
    batch_rows: int = 1,
    layout: TokenLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Token sequences to audio through a codec decoder; rows with an error have none."""
    decoded = decode_sequences(
        df, ids=ids, with_text=with_text, strict=strict, detokenizer=detokenizer, layout=layout
    )
    return decode_audio(decoded, load_decoder, batch_rows=batch_rows)
