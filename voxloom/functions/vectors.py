"""Similarity of feature vectors and feature matrices."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.arrays import as_column, truncate_to_shorter

ZERO = 0.0

# Weights of the overall score.
WEIGHTS: Mapping[str, float] = {
    "mfcc_similarity": 0.35,
    "chroma_similarity": 0.25,
    "spectral_centroid_similarity": 0.15,
    "dtw_similarity": 0.25,
}
METRICS = (*WEIGHTS, "overall_score")
METRIC_DIGITS = 4

# Upper bound on the float64 cells that one step of the alignment holds.
DTW_CELLS = 4_000_000


def mean_pool(matrix: Column | str) -> Column:
    """``(features, frames)`` matrix to one mean per feature row; null for a row without frames."""
    return F.transform(
        as_column(matrix),
        lambda row: F.try_divide(F.aggregate(row, F.lit(ZERO), lambda acc, v: acc + v), F.array_size(row)),
    )


def matrix_fault(matrix: Column | str) -> Column:
    """Why a feature matrix cannot be scored, or null for a sound one.

    ``missing_features`` (null), ``empty_features`` (no rows, or a row that is null
    or without frames), ``ragged_features`` (rows of different lengths),
    ``null_features`` (a value that is null or not finite).
    """
    matrix = as_column(matrix)
    sizes = F.transform(matrix, lambda row: F.coalesce(F.array_size(row), F.lit(0)))
    odd = F.exists(matrix, lambda row: F.exists(row, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return (
        F.when(matrix.isNull(), "missing_features")
        .when((F.array_size(matrix) == 0) | F.array_contains(sizes, 0), "empty_features")
        .when(F.array_min(sizes) != F.array_max(sizes), "ragged_features")
        .when(odd, "null_features")
    )


def height_fault(ref: Column | str, gen: Column | str) -> Column:
    """``unequal_features`` for two matrices of different heights, else null."""
    return F.when(F.array_size(as_column(ref)) != F.array_size(as_column(gen)), "unequal_features")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(ZERO),
        lambda acc, v: acc + v,
    )


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors after cutting both to the shorter; 0 for a zero vector."""
    a, b = truncate_to_shorter(a, b)
    aa, bb = dot(a, a), dot(b, b)
    return F.when((aa == ZERO) | (bb == ZERO), F.lit(ZERO)).otherwise(
        dot(a, b) / (F.sqrt(aa) * F.sqrt(bb))
    )


def overall_score(parts: Mapping[str, Column]) -> Column:
    """Weighted sum of the four unrounded similarities."""
    total = F.lit(ZERO)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * parts[name]
    return total


def round_metric(value: Column | str) -> Column:
    return F.round(as_column(value), METRIC_DIGITS)


def _matrices(column: pa.Array, valid: np.ndarray) -> list[np.ndarray]:
    """Arrow ``list<list<double>>`` (features by frames) as frames-by-features arrays.

    Empty where there is nothing sound to compare: no rows or frames, rows that are
    null or of different lengths, values that are null or not finite.
    """
    rows = column.values
    flat = rows.values.to_numpy(zero_copy_only=False)
    row_at = rows.offsets.to_numpy()
    there = rows.is_valid().to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy()
    out = []
    for i, ok in enumerate(valid):
        first, last = (int(at[i]), int(at[i + 1])) if ok else (0, 0)
        lengths = np.diff(row_at[first : last + 1])
        values = flat[row_at[first] : row_at[last]] if last > first else flat[:0]
        if len(values) and there[first:last].all() and (lengths == lengths[0]).all() and np.isfinite(values).all():
            out.append(values.reshape(last - first, -1).T)
        else:
            out.append(np.empty((0, 0)))
    return out


def alignment_cost(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Cheapest monotone alignment of each ``xs[p]`` with ``ys[p]``.

    All pairs advance together along the anti-diagonals of their cost grids.
    Cells outside a pair's own grid are computed but never read by a cell
    inside it, so padding does not change any result.
    """
    pairs = len(xs)
    n = np.array([len(x) for x in xs])
    m = np.array([len(y) for y in ys])
    height, width, depth = int(n.max()), int(m.max()), xs[0].shape[1]
    x = np.zeros((pairs, height, depth))
    # Reversed, so that the columns of an anti-diagonal are one slice.
    y = np.zeros((pairs, width, depth))
    for p in range(pairs):
        x[p, : n[p]] = xs[p]
        y[p, width - m[p] :] = ys[p][::-1]
    cost = np.full(pairs, np.nan)
    # Slot i + 1 holds row i of an anti-diagonal; cells outside the grid are infinite.
    before, last, now = (np.full((pairs, height + 1), np.inf) for _ in range(3))
    for d in range(height + width - 1):
        lo, hi = max(0, d - width + 1), min(height - 1, d)
        gap = x[:, lo : hi + 1] - y[:, width - 1 - d + lo : width - d + hi]
        local = np.sqrt(np.einsum("pkd,pkd->pk", gap, gap))
        now[:, lo] = np.inf
        if d == 0:
            now[:, 1] = local[:, 0]
        else:
            best = np.minimum(last[:, lo : hi + 1], last[:, lo + 1 : hi + 2])
            np.minimum(best, before[:, lo : hi + 1], out=best)
            np.add(best, local, out=now[:, lo + 1 : hi + 2])
        if hi + 2 <= height:
            now[:, hi + 2] = np.inf
        done = np.nonzero(n + m - 2 == d)[0]
        cost[done] = now[done, n[done]]
        before, last, now = last, now, before
    return cost


def _chunks(order: np.ndarray, cells: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of similar size whose padded rows stay below ``DTW_CELLS``."""
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and cells[order[stop]] * (stop + 1 - start) <= DTW_CELLS:
            stop += 1
        yield order[start:stop]
        start = stop


@F.arrow_udf(T.DoubleType())
def _alignment_similarity(ref: pa.Array, gen: pa.Array) -> pa.Array:
    valid = ref.is_valid().to_numpy(zero_copy_only=False) & gen.is_valid().to_numpy(zero_copy_only=False)
    out = np.full(len(valid), np.nan)
    xs, ys = _matrices(ref, valid), _matrices(gen, valid)
    frames = np.array([len(x) + len(y) for x, y in zip(xs, ys)], dtype=np.int64)
    same = [len(x) and len(y) and x.shape[1] == y.shape[1] for x, y in zip(xs, ys)]
    depths = np.array([x.shape[1] if ok else 0 for x, ok in zip(xs, same)], dtype=np.int64)
    for depth in np.unique(depths[depths > 0]):
        group = np.nonzero(depths == depth)[0]
        order = group[np.argsort(frames[group], kind="stable")]
        for chunk in _chunks(order, frames * int(depth)):
            cost = alignment_cost([xs[p] for p in chunk], [ys[p] for p in chunk])
            out[chunk] = 1.0 / (1.0 + cost / frames[chunk])
    return pa.array(out, mask=depths == 0)


def dtw_similarity(ref: Column | str, gen: Column | str) -> Column:
    """``1 / (1 + cost / (N + M))`` of the dynamic-time-warping alignment.

    Both sides are ``(features, frames)`` matrices; N and M are the frame
    counts.  Frames are compared by Euclidean distance.  One pair is one row,
    so the work is spread by row and needs no grouping.  A pair that cannot be
    compared (see ``matrix_fault``, ``height_fault``) gets null; the others do not
    notice.
    """
    # Not deterministic to the optimizer, so that no filter on the result aligns twice.
    align = _alignment_similarity.asNondeterministic()
    return align(as_column(ref).cast("array<array<double>>"), as_column(gen).cast("array<array<double>>"))
