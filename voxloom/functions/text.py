"""Prompt text and tokenizers.

A tokenizer is any ``Column -> Column`` function from text to ``array<int>``.
``char_tokenizer`` needs no model and stays in the JVM; ``arrow_tokenizer``
wraps a model that has to run in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxloom.functions.arrays import INT_ARRAY, as_column, empty_ints, int_array
from voxloom.vocab import DEFAULT_LAYOUT, TokenLayout

Tokenizer = Callable[[Column], Column]
# From ids without markers to the text, null where the ids spell none.
Detokenizer = Callable[[Column], Column]

# Character ids start above the two text markers and stay below the text vocabulary.  A
# character below CHAR_PAIRS is its code point; any other is a pair, the upper bits from
# CHAR_PAIRS on and the lower ten bits from CHAR_LOW on, so that every text comes back.
CHAR_BASE = 3
CHAR_PAIRS = 0xD800
CHAR_LOW = 0xDE00
CHAR_TOP = 0x10FFFF

# Characters whose ids a worker holds at once.
PART_CHARS = 250_000


def speaker_prompt(text: Column | str, speaker: Column | None = None, speaker_id: str | None = None) -> Column:
    """``"<speaker>: <text>"`` in lower-case speaker, or the bare text without one.

    A fixed ``speaker_id`` wins over the row's own speaker.  An empty speaker
    counts as set.
    """
    text = as_column(text)
    if speaker_id is not None:
        return F.concat(F.lit(speaker_id.lower() + ": "), text)
    if speaker is None:
        return text
    return F.when(speaker.isNotNull(), F.concat(F.lower(speaker), F.lit(": "), text)).otherwise(text)


def text_preview(text: Column | str, length: int = 100) -> Column:
    return F.substring(as_column(text), 1, length)


def char_ids(text: Column | str) -> Column:
    """One id per character, two per character from ``CHAR_PAIRS`` on."""
    text = as_column(text)
    base, pairs, low = F.lit(CHAR_BASE), F.lit(CHAR_BASE + CHAR_PAIRS), F.lit(CHAR_BASE + CHAR_LOW)

    def spelled(c: Column) -> Column:
        point = F.ascii(c)
        pair = F.array(F.shiftright(point, 10) + pairs, point.bitwiseAND(1023) + low)
        return F.when(point < CHAR_PAIRS, F.array(point + base)).otherwise(pair)

    chars = F.split(text, "")
    plain = F.transform(chars, lambda c: F.ascii(c) + base)
    # Texts with such characters are rare: only they pay for arrays of arrays.
    rare = F.rlike(text, F.lit(r"[^\x{0}-\x{D7FF}]"))
    ids = F.when(rare, F.flatten(F.transform(chars, spelled))).otherwise(plain)
    return F.when(F.length(text) > 0, ids).otherwise(empty_ints())


def text_ids(points: np.ndarray) -> np.ndarray:
    """Inverse of ``_points``, for the code points of a text."""
    rare = points >= CHAR_PAIRS
    if not rare.any():
        return points + CHAR_BASE
    ids = np.repeat(points, rare + 1) + CHAR_BASE
    first = np.flatnonzero(rare) + np.arange(rare.sum())
    ids[first] = (points[rare] >> 10) + CHAR_BASE + CHAR_PAIRS
    ids[first + 1] = (points[rare] & 1023) + CHAR_BASE + CHAR_LOW
    return ids


def _point_lists(batch: pa.Array, to: Callable[[np.ndarray], np.ndarray], kind: pa.DataType) -> Iterator[pa.Array]:
    """A list per text from its code points, null for none, in parts of at most ``PART_CHARS`` characters or one text."""

    def part() -> pa.Array:
        ends = np.cumsum([0, *(0 if x is None else len(x) for x in lists)], dtype=np.int32)
        values = np.concatenate([x for x in lists if x is not None] or [np.zeros(0)])
        mask = pa.array([x is None for x in lists])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind.to_pandas_dtype()), kind), mask=mask)

    lists: list[np.ndarray | None] = []
    held = 0
    for text in batch:
        # Bytes that are no text are replaced, as they are in the JVM.
        raw = text.as_buffer().to_pybytes().decode("utf-8", "replace").encode("utf-32-le") if text.is_valid else None
        if lists and held + (len(raw or b"") // 4) > PART_CHARS:
            yield part()
            lists, held = [], 0
        lists.append(None if raw is None else to(np.frombuffer(raw, "<i4")))
        held += len(raw or b"") // 4
    if lists:
        yield part()


def char_lists(text: Column | str, to: Callable[[np.ndarray], np.ndarray] = text_ids, item: T.DataType = T.IntegerType()) -> Column:
    """``to`` of every text's code points, as a list; null for none.  Runs in Python on Arrow batches."""

    @F.arrow_udf(T.ArrayType(item))
    def spell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = to_arrow_type(item)
        for batch in batches:
            yield from _point_lists(batch, to, kind)

    return spell(as_column(text))


def batch_char_tokenizer(*, add_start: bool = True, layout: TokenLayout = DEFAULT_LAYOUT) -> Tokenizer:
    """The ids of ``char_tokenizer``, made in Python on Arrow batches: faster for long texts."""

    def tokenize(text: Column) -> Column:
        ids = F.coalesce(char_lists(text), empty_ints())
        return F.concat(int_array([layout.start_of_text]), ids) if add_start else ids

    return tokenize


def char_tokenizer(*, add_start: bool = True, layout: TokenLayout = DEFAULT_LAYOUT) -> Tokenizer:
    """Characters as ids, after the start-of-text marker unless switched off."""

    def tokenize(text: Column) -> Column:
        ids = char_ids(text)
        return F.concat(int_array([layout.start_of_text]), ids) if add_start else ids

    return tokenize


def _points(ids: np.ndarray) -> np.ndarray | None:
    """Code points of ids; ``None`` if they spell no text."""
    values = ids.astype(np.int64) - CHAR_BASE
    if not len(values) or (values.min() >= 0 and values.max() < CHAR_PAIRS):
        return values
    plain = (values >= 0) & (values < CHAR_PAIRS)
    high = (values >= CHAR_PAIRS) & (values <= CHAR_PAIRS + (CHAR_TOP >> 10))
    low = (values >= CHAR_LOW) & (values < CHAR_LOW + 1024)
    # Every first half is followed by a second one, and no second one stands alone.
    if not (plain | high | low).all() or high[-1] or low[0] or (high[:-1] != low[1:]).any():
        return None
    at = np.flatnonzero(high)
    values[at] = ((values[at] - CHAR_PAIRS) << 10) + values[at + 1] - CHAR_LOW
    return None if (values[at] < CHAR_PAIRS + 0x800).any() else values[~low]


def _spelled(ids: pa.Scalar) -> str | None:
    if not ids.is_valid or ids.values.null_count:
        return None
    points = _points(ids.values.to_numpy())
    return None if points is None else points.astype("<u4").tobytes().decode("utf-32-le")


def chars_from_ids(ids: Column | str) -> Column:
    """Inverse of ``char_ids``; null for ids that spell no text.  Runs in Python on Arrow batches."""

    @F.arrow_udf(T.StringType())
    def spell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_spelled(x) for x in batch], pa.string())

    return spell(as_column(ids).cast(INT_ARRAY))


def char_detokenizer() -> Detokenizer:
    return chars_from_ids


def _parts(batch: pa.Array) -> Iterator[pa.Array]:
    """A batch of lists, cut where they reach ``PART_CHARS`` items; a longer list stays whole."""
    start, held = 0, 0
    for i, size in enumerate(pc.list_value_length(batch).fill_null(0).to_pylist()):
        if i > start and held + size > PART_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def arrow_detokenizer(load: Callable[[], Callable[[list[list[int]]], Sequence[str | None]]]) -> Detokenizer:
    """A detokenizer that runs in Python on Arrow batches.

    ``load`` is called once per task and returns a function from a list of id
    lists to a list of texts.  Lists of at most ``PART_CHARS`` ids together, or one
    longer list, are passed at once; if they fail they are tried again one by one, and
    what still fails has no text.
    """

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode_ids = load()

        def one(ids: list[int]) -> str | None:
            try:
                return decode_ids([ids])[0]
            except Exception:  # isolate the row
                return None

        for batch in batches:
            for part in _parts(batch):
                lists = [x for x in part.to_pylist() if x is not None]
                try:
                    texts = list(decode_ids(lists))
                    if len(texts) != len(lists):
                        raise ValueError("wrong number of texts")
                except Exception:
                    texts = [one(ids) for ids in lists]
                found = iter(texts)
                yield pa.array([next(found) if ok else None for ok in part.is_valid().to_pylist()], pa.string())

    return lambda ids: decode(ids)


def arrow_tokenizer(load: Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]]) -> Tokenizer:
    """A tokenizer that runs in Python on Arrow batches.

    ``load`` is called once per task and returns a function from a list of
    texts to a list of id lists.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode_texts = load()
        for batch in batches:
            valid = batch.is_valid().to_pylist()
            encoded = iter(encode_texts([t for t in batch.to_pylist() if t is not None]))
            yield pa.array(
                [list(next(encoded)) if ok else None for ok in valid], type=pa.list_(pa.int32())
            )

    return lambda text: encode(text)


def model_file_tokenizer(path: str, *, add_special_tokens: bool = True) -> Tokenizer:
    """A ``tokenizers`` model file, loaded once per task."""

    def load() -> Callable[[list[str]], Sequence[Sequence[int]]]:
        from tokenizers import Tokenizer as Model

        model = Model.from_file(path)

        def encode_texts(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in model.encode_batch(texts, add_special_tokens=add_special_tokens)]

        return encode_texts

    return arrow_tokenizer(load)


def model_file_detokenizer(path: str) -> Detokenizer:
    """Texts through a ``tokenizers`` model file, special tokens skipped; loaded once per task."""

    def load() -> Callable[[list[list[int]]], Sequence[str]]:
        from tokenizers import Tokenizer as Model

        model = Model.from_file(path)
        return lambda lists: model.decode_batch(lists, skip_special_tokens=True)

    return arrow_detokenizer(load)
