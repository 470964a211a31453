"""Token sequences: layout, frame-level positions, and the way back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.arrays import as_column, empty_ints, int_array, int_range, occurrences
from voxloom.vocab import DEFAULT_LAYOUT, TokenLayout


def input_ids(text_tokens: Column | str, codes: Column | str, layout: TokenLayout = DEFAULT_LAYOUT) -> Column:
    """Human turn with the text, then the AI turn with the audio tokens.

    ``text_tokens`` already ends with the end-of-text marker.
    """
    return F.concat(
        int_array([layout.start_of_human]),
        as_column(text_tokens),
        int_array([layout.end_of_human, layout.start_of_ai, layout.start_of_speech]),
        as_column(codes),
        int_array([layout.end_of_speech, layout.end_of_ai]),
    )


def prefix_length(text_tokens: Column | str) -> Column:
    """Tokens before the first audio token."""
    return F.array_size(as_column(text_tokens)) + 4


def sequence_length(text_tokens: Column | str, frame_count: Column | str, layout: TokenLayout = DEFAULT_LAYOUT) -> Column:
    """Size of ``input_ids`` without building it."""
    return prefix_length(text_tokens) + as_column(frame_count) * layout.codebooks + 2


def repeat_per_frame(start: Column, frames: Column, width: int) -> Column:
    """``start`` ``width`` times, then ``start+1`` ``width`` times, …"""
    return F.flatten(F.transform(int_range(start, frames), lambda p: F.array_repeat(p, width)))


def frame_position_ids(
    prefix: Column | str, frame_count: Column | str, layout: TokenLayout = DEFAULT_LAYOUT
) -> Column:
    """Positions that advance once per audio frame instead of once per token."""
    prefix, frames = as_column(prefix), as_column(frame_count)
    return F.concat(
        int_range(F.lit(0), prefix),
        repeat_per_frame(prefix, frames, layout.codebooks),
        F.array(prefix + frames, prefix + frames + 1),
    )


def ones_like(values: Column | str) -> Column:
    return F.array_repeat(F.lit(1), F.array_size(as_column(values)))


def prompt_ids(text_tokens: Column | str, layout: TokenLayout = DEFAULT_LAYOUT) -> Column:
    """Inference prompt: the human turn alone."""
    return F.concat(
        int_array([layout.start_of_human]),
        as_column(text_tokens),
        int_array([layout.end_of_text, layout.end_of_human]),
    )


def plain_positions(ids: Column | str) -> Column:
    return int_range(F.lit(0), F.array_size(as_column(ids)))


def rebuild_positions(ids: Column | str, layout: TokenLayout = DEFAULT_LAYOUT) -> Column:
    """Frame-level positions recomputed from the ids alone.

    The audio region runs from after the first start-of-speech marker to the
    first end-of-speech marker, or to the end without one.  A trailing partial
    frame gets a position of its own.  Null when the end precedes the start.
    """
    ids = as_column(ids)
    width = layout.codebooks
    begin = F.array_position(ids, layout.start_of_speech).cast("int")
    end_at = F.array_position(ids, layout.end_of_speech).cast("int")
    end = F.when(end_at > 0, end_at - 1).otherwise(F.array_size(ids))
    audio = end - begin
    frames = F.ceil(audio / width).cast("int")
    framed = F.concat(
        int_range(F.lit(0), begin),
        F.slice(repeat_per_frame(begin, frames, width), 1, F.greatest(audio, F.lit(0))),
        int_range(begin + frames, F.array_size(ids) - end),
    )
    return F.when(begin == 0, plain_positions(ids)).when(end >= begin, framed)


def has_markers(ids: Column | str, layout: TokenLayout = DEFAULT_LAYOUT) -> Column:
    ids = as_column(ids)
    return F.array_contains(ids, layout.start_of_speech) & F.array_contains(ids, layout.end_of_speech)


def marker_error(ids: Column | str, layout: TokenLayout = DEFAULT_LAYOUT) -> Column:
    """``missing_marker``, ``ambiguous_marker``, ``bad_order`` or null."""
    ids = as_column(ids)
    start = F.array_position(ids, layout.start_of_speech)
    end = F.array_position(ids, layout.end_of_speech)
    return (
        F.when(ids.isNull() | (start == 0) | (end == 0), F.lit("missing_marker"))
        .when(
            (occurrences(ids, layout.start_of_speech) != 1) | (occurrences(ids, layout.end_of_speech) != 1),
            F.lit("ambiguous_marker"),
        )
        .when(start >= end, F.lit("bad_order"))
    )


def audio_region(ids: Column | str, layout: TokenLayout = DEFAULT_LAYOUT) -> Column:
    """Tokens strictly between the speech markers; the markers must be valid."""
    ids = as_column(ids)
    start = F.array_position(ids, layout.start_of_speech).cast("int")
    end = F.array_position(ids, layout.end_of_speech).cast("int")
    return F.slice(ids, start + 1, end - start - 1)


def text_span(ids: Column | str, layout: TokenLayout = DEFAULT_LAYOUT) -> Column:
    """Tokens from the only start-of-text to the only end-of-text, inclusive.

    Null unless each marker occurs exactly once.  An end before the start gives
    an empty span.
    """
    ids = as_column(ids)
    start = F.array_position(ids, layout.start_of_text).cast("int")
    end = F.array_position(ids, layout.end_of_text).cast("int")
    single = (occurrences(ids, layout.start_of_text) == 1) & (occurrences(ids, layout.end_of_text) == 1)
    return F.when(
        single,
        F.when(end >= start, F.slice(ids, start, end - start + 1)).otherwise(empty_ints()),
    )
