"""Codec frames: four integer layers zipped into one array of structs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.arrays import as_column
from voxloom.vocab import DEFAULT_LAYOUT, FRAMES_PER_SECOND, LAYERS, TokenLayout

INT_MIN = -(2**31)


def frames_to_seconds(length: Column | str) -> Column:
    return as_column(length) / F.lit(FRAMES_PER_SECOND)


def max_frames(max_seconds: float) -> int:
    """Longest frame count that lasts no more than ``max_seconds``."""
    return math.floor(FRAMES_PER_SECOND * max_seconds)


def within_duration(length: Column | str, max_seconds: float | None) -> Column:
    """``length / 12.5 <= max_seconds`` as an integer comparison.

    Only a bare column against a literal reaches the Parquet row-group filter.
    0 or None means no limit.
    """
    if not max_seconds:
        return F.lit(True)
    return as_column(length) <= F.lit(max_frames(max_seconds))


def zip_frames(layers: Sequence[str] = LAYERS) -> Column:
    """``array<struct<layer 1..4>>``, one struct per frame.

    The layers must have equal sizes (see ``layer_error``): ``arrays_zip`` pads
    the short ones with nulls.
    """
    return F.arrays_zip(*[F.col(name) for name in layers])


def distinct_frames(layers: Sequence[str] = LAYERS) -> Column:
    """As ``zip_frames``, without the frames that equal the frame just before them.

    Each frame is zipped with its predecessor's codes, so the lambda reads
    nothing but its argument: a lambda that looks back into the whole array
    would make the work quadratic wherever the optimizer inlines that array.
    """
    before = [f"_before_{name}" for name in layers]
    shifted = [
        F.concat(F.array(F.lit(None).cast("int")), F.slice(name, 1, F.greatest(F.array_size(name) - 1, F.lit(0))))
        for name in layers
    ]
    pairs = F.arrays_zip(
        *[F.col(name) for name in layers], *[c.alias(b) for c, b in zip(shifted, before)]
    )

    def differs(pair: Column) -> Column:
        out = F.lit(False)
        for name, b in zip(layers, before):
            out = out | ~pair[name].eqNullSafe(pair[b])
        return out

    return F.when(F.array_size(layers[0]) > 0, F.filter(pairs, differs)).otherwise(F.slice(pairs, 1, 0))


def interleave(
    frames: Column | str,
    layers: Sequence[str] = LAYERS,
    layout: TokenLayout = DEFAULT_LAYOUT,
) -> Column:
    """Frames as one flat token array, each code moved to its codebook's range."""

    def tokens(frame: Column) -> Column:
        return F.array(
            *[frame[name] + F.lit(layout.codebook_start(k)) for k, name in enumerate(layers)]
        )

    return F.flatten(F.transform(as_column(frames), tokens))


def _any_of(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def has_null_item(values: Column | str) -> Column:
    """Whether an int array holds a null.

    A search that finds nothing is null, not false, if there are null items;
    no code is the smallest int.
    """
    return F.array_contains(as_column(values), INT_MIN).isNull()


def layer_error(layers: Sequence[str] = LAYERS) -> Column:
    """``null_layer``, ``ragged_layers``, ``empty_layers``, ``null_code`` or null."""
    cols = [F.col(name) for name in layers]
    first = F.array_size(cols[0])
    return (
        F.when(_any_of([c.isNull() for c in cols]), F.lit("null_layer"))
        .when(_any_of([F.array_size(c) != first for c in cols[1:]]), F.lit("ragged_layers"))
        .when(first == 0, F.lit("empty_layers"))
        .when(_any_of([has_null_item(c) for c in cols]), F.lit("null_code"))
    )


def deinterleave(
    tokens: Column | str,
    k: int,
    layout: TokenLayout = DEFAULT_LAYOUT,
) -> Column:
    """Codes of codebook ``k`` (0-based) from a flat run of audio tokens."""
    own = F.filter(as_column(tokens), lambda _, i: i % layout.codebooks == k)
    return F.transform(own, lambda token: token - F.lit(layout.codebook_start(k)))


def mono_downmix(samples: Column | str, channels: int | None = None) -> Column:
    """``array<array<double>>`` of samples by channel to the mean over channels.

    A known number of channels saves the inner loop per sample.
    """

    def mean(sample: Column) -> Column:
        if channels is None:
            return F.aggregate(sample, F.lit(0.0), lambda acc, v: acc + v) / F.array_size(sample)
        total = F.get(sample, F.lit(0))
        for c in range(1, channels):
            total = total + F.get(sample, F.lit(c))
        return total / channels

    return F.transform(as_column(samples), mean)
