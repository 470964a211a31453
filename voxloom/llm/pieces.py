"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding is the byte-pair form of SentencePiece: the symbols of a text start as its
characters; an agenda holds every adjacent pair that is a piece; the pair of the
best score, the leftmost of equals, is taken and merged until none is left.  With
dropout, a pair that the agenda hands out is skipped if a keyed hash of the seed,
the text's key and the pair's place falls below the dropout share.  The hash needs
no random state: the same seed gives the same pieces on any machine and at any
retry, another seed others, and all of them decode to the same text.

Pieces never reach over a word's end, so agendas are kept per word.  Short words
go through their agendas side by side in numpy; a long word has a heap of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StringType, StructField, StructType

from voxloom.llm.common import blocks, map_arrow, row_and, with_fields

SPACE = "▁"
BLOCK_BYTES = 250_000  # text whose arrays a worker holds at once
LONG_WORD = 64
SLICE = 120_000
_LAST = np.int64(1) << 62  # agenda entries of no piece begin here
_NO_SYMBOL = 65535  # stands for every character without a symbol
_EMPTY = 0xFFFFFFFF
_SPREAD = 2654435769


@dataclass(frozen=True)
class Dropout:
    """Share of the agenda's pairs that are skipped, and the key of their hash."""

    share: float = 0.1
    seed: int = 1


class Pieces:
    """The merge table of a SentencePiece model of byte-pair type with byte fallback.

    Symbols are piece ids; characters that only occur inside longer pieces have
    numbers after the ids, all others ``outside`` plus their code point.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(size)]
        byte = [model.is_byte(i) for i in range(size)]
        usual = [i for i in range(size) if not (byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(size):
            if byte[i]:
                self.byte_ids[int(texts[i][3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError(f"{path}: the model has no byte fallback")
        symbol = {texts[i]: i for i in usual}
        if any(SPACE in t.lstrip(SPACE) for t in symbol):
            raise ValueError(f"{path}: the model has pieces that reach over a word's end")
        inner = sorted({c for t in symbol for c in t} - set(symbol))
        symbol |= {c: len(texts) + k for k, c in enumerate(inner)}
        self.outside = len(texts) + len(inner)
        self.chars = np.arange(0x110000, dtype=np.int32) + self.outside
        for t, i in symbol.items():
            if len(t) == 1:
                self.chars[ord(t)] = i
        # A literal U+2581 would decode to a blank: it goes through its bytes.
        self.blank = int(self.chars[ord(SPACE)])
        self.chars[ord(" ")] = self.blank
        self.chars[ord(SPACE)] = self.outside + ord(SPACE)
        if self.outside >= _NO_SYMBOL:
            raise ValueError(f"{path}: more symbols than the merge table can tell apart")
        scores = {i: model.get_score(i) for i in usual}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # Rank of each piece in the agenda; no piece (-1) comes last.
        self.ranks = np.full(len(texts) + 1, 1 << 30, np.int64)
        for i, s in scores.items():
            self.ranks[i] = order[s]
        merges = {
            (symbol[t[:k]] << 16) | symbol[t[k:]]: symbol[t]
            for t in symbol if len(t) > 1 for k in range(1, len(t)) if t[:k] in symbol and t[k:] in symbol
        }
        # An open hash table of pairs: four bytes for the pair, four for the piece.
        self.bits = max(10, (2 * len(merges)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY, np.uint32)
        self.values = np.full(1 << self.bits, -1, np.int32)
        for key, to in merges.items():
            at = (key * _SPREAD & 0xFFFFFFFF) >> (32 - self.bits)
            while self.keys[at] != _EMPTY:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, to
        self.output = [t.replace(SPACE, " ").encode() if i in scores else b"" for i, t in enumerate(texts)]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.output[i] = bytes([b])

    def pair_pieces(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        key = (np.minimum(left, _NO_SYMBOL).astype(np.uint32) << np.uint32(16)) | np.minimum(right, _NO_SYMBOL).astype(np.uint32)
        at = ((key * np.uint32(_SPREAD)) >> np.uint32(32 - self.bits)).astype(np.int64)
        found = self.keys.take(at)
        out = self.values.take(at)
        miss = found != key
        out[miss] = -1
        where = np.flatnonzero(miss & (found != _EMPTY))
        key, at = key[where], at[where]
        while len(where):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == key
            out[where[hit]] = self.values[at[hit]]
            further = ~hit & (found != _EMPTY)
            where, key, at = where[further], key[further], at[further]
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kept(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, share: float) -> np.ndarray:
    """Which pairs the keyed hash of (text, start, middle, end) does not skip."""
    if share <= 0:
        return np.ones(len(start), bool)
    spot = start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + middle.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = _mix(key + spot + end.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return x >= np.uint64(min(int(share * 2.0**64), 2**64 - 1))


class _Words:
    """What the pairs of a block of texts are judged by: the merge table, the dropout and each text's key."""

    def __init__(self, pieces: Pieces, share: float, keys: np.ndarray, base: np.ndarray):
        self.pieces, self.share, self.keys, self.base = pieces, share, keys, base

    def pieces_of(self, left: np.ndarray, right: np.ndarray, text: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1 for none and for pairs that are skipped."""
        made = self.pieces.pair_pieces(left, right)
        real = np.flatnonzero(made >= 0)
        made[real[~self.keeps(text[real], start[real], middle[real], end[real])]] = -1
        return made

    def keeps(self, text: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which pairs the dropout leaves in."""
        base = self.base.take(text)
        return kept(self.keys.take(text), start - base, middle - base, end - base, self.share)


def _merge_short(words: _Words, sym: np.ndarray, text: np.ndarray, place: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
    """Run the agendas of all words at once; the symbols that remain go to ``out`` at their start.

    ``place`` is each symbol's first character, ``sizes`` the number of symbols of
    each word, ``text`` the number of each word's text.
    """
    place = place.astype(np.int32)
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    first = np.cumsum(sizes) - sizes
    ends = place[first + sizes - 1].astype(np.int64) + 1  # symbols are single characters here

    def judge(left: np.ndarray) -> np.ndarray:
        """Agenda entries, (rank << 32 | place), of the pairs that begin at ``left``."""
        made = words.pieces.pair_pieces(sym.take(left), sym.take(left + 1))
        entries = np.full(len(left), _LAST)
        real = np.flatnonzero(made >= 0)
        if not len(real):
            return entries
        left, made = left[real], made[real]
        w, start = word.take(left), place.take(left).astype(np.int64)
        beyond = np.minimum(left + 2, len(sym) - 1)
        inside = (word.take(beyond) == w) & (beyond == left + 2)
        end = np.where(inside, place.take(beyond), ends.take(w))
        good = words.keeps(text.take(w), start, place.take(left + 1).astype(np.int64), end)
        entries[real[good]] = (words.pieces.ranks.take(made[good]) << 32) | start[good]
        return entries

    agenda = np.full(len(sym), _LAST)
    inner = np.ones(len(sym), bool)
    inner[first + sizes - 1] = False
    left = np.flatnonzero(inner)
    agenda[left] = judge(left)
    while len(sym):
        best = np.minimum.reduceat(agenda, first)  # the best rank first, then the leftmost
        live = best < _LAST
        spots = best[live] & 0xFFFFFFFF
        at = np.searchsorted(place, spots)
        keep = np.ones(len(sym), bool)
        if not live.all():
            done = np.repeat(~live, sizes)
            out[place[done]] = sym[done]
            keep = ~done
            sizes = sizes[live]
        if not len(at):
            return
        sym[at] = words.pieces.pair_pieces(sym[at], sym[at + 1])
        agenda[at] = agenda[at + 1]
        keep[at + 1] = False
        sym, place, word, agenda = sym[keep], place[keep], word[keep], agenda[keep]
        sizes = sizes - 1
        first = np.cumsum(sizes) - sizes
        at = np.searchsorted(place, spots)
        # Only the pairs on either side of a merge changed.
        agenda[at] = _LAST
        changed = np.concatenate((at[at > first] - 1, at[at + 1 < first + sizes]))
        agenda[changed] = judge(changed)


def _merge_long(words: _Words, sym: np.ndarray, text: int, place: int, out: np.ndarray) -> None:
    """The agenda of one word, on a heap."""
    from heapq import heapify, heappop, heappush

    n = len(sym)
    start = np.arange(place, place + n)
    texts = np.full(n, text)
    symbols, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    made = words.pieces_of(sym[:-1], sym[1:], texts, start[:-1], start[1:], start[1:] + 1).tolist()
    ranks = words.pieces.ranks
    agenda = [(int(ranks[m]), i, symbols[i], symbols[i + 1], i + 2, m) for i, m in enumerate(made) if m >= 0]
    heapify(agenda)
    owner = texts[:1]

    def push(i: int) -> None:
        j = after[i]
        if j < n:
            spots = [np.array([place + x]) for x in (i, j, after[j])]
            m = int(words.pieces_of(np.array([symbols[i]]), np.array([symbols[j]]), owner, *spots)[0])
            if m >= 0:
                heappush(agenda, (int(ranks[m]), i, symbols[i], symbols[j], after[j], m))

    while agenda:
        _, i, left, right, end, merged = heappop(agenda)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right or after[j] != end:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = merged, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    for i, s in enumerate(symbols):
        if s >= 0:
            out[place + i] = s


def encode_texts(pieces: Pieces, texts: list[str | None], keys: np.ndarray, share: float) -> list[np.ndarray | None]:
    """Piece ids of each text; ``keys`` (unsigned 64-bit) tell the texts apart for the dropout."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
    sizes = np.array([len(p) + 1 if len(p) else 0 for p in points])
    base = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    empty = np.zeros(0, np.int32)
    if not total:
        return [None if t is None else empty for t in texts]
    sym = np.full(total, pieces.blank, np.int32)  # a blank goes before each text
    inside = np.ones(total, bool)
    inside[base[sizes > 0]] = False
    sym[inside] = pieces.chars[np.concatenate(points)]
    text = np.repeat(np.arange(len(texts)), sizes)
    blank = sym == pieces.blank
    begins = blank & ~np.append(False, blank[:-1]) | ~inside
    first = np.flatnonzero(begins)
    lengths = np.diff(np.append(first, total))
    out = np.full(total, -1, np.int32)
    words = _Words(pieces, share, keys, base)
    brief = np.flatnonzero(lengths <= LONG_WORD)
    ends = np.cumsum(lengths[brief])
    # Slices of whole words that fit the processor's cache.
    cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, SLICE), side="left")
    for a, b in zip(cuts, np.append(cuts[1:], len(brief))):
        if a < b:
            chosen = brief[a:b]
            sizes = lengths[chosen]
            at = np.repeat(first[chosen] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            _merge_short(words, sym[at], text[first[chosen]], at, sizes, out)
    for w in np.flatnonzero(lengths > LONG_WORD).tolist():
        _merge_long(words, sym[first[w] : first[w] + lengths[w]], int(text[first[w]]), int(first[w]), out)
    spots = np.flatnonzero(out >= 0)
    ids, owner = out[spots], text[spots]
    outside = np.flatnonzero(ids >= len(pieces.output))
    if len(outside):  # byte fallback
        spelled = [list(chr(p).encode("utf-8", "surrogatepass")) for p in _code_points(pieces, ids[outside])]
        counts = np.ones(len(ids), np.int64)
        counts[outside] = [len(s) for s in spelled]
        at = np.cumsum(counts) - counts
        wide = np.repeat(ids, counts)
        for a, s in zip(at[outside].tolist(), spelled):
            wide[a : a + len(s)] = pieces.byte_ids[s]
        ids, owner = wide, np.repeat(owner, counts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [None if t is None else ids[cuts[i] : cuts[i + 1]] for i, t in enumerate(texts)]


def _code_points(pieces: Pieces, symbols: np.ndarray) -> list[int]:
    """Characters of symbols that are no pieces."""
    inner = {int(pieces.chars[c]): c for c in np.flatnonzero((pieces.chars >= len(pieces.output)) & (pieces.chars < pieces.outside))}
    return [inner[s] if s < pieces.outside else s - pieces.outside for s in symbols.tolist()]


def decode_ids(pieces: Pieces, ids: list[int] | None) -> str | None:
    """The text of piece ids: the blank before it goes, bytes that are not UTF-8 become U+FFFD."""
    if ids is None:
        return None
    return b"".join(map(pieces.output.__getitem__, ids))[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, pieces: Pieces, how: Dropout = Dropout(), key: Column | None = None) -> DataFrame:
    """``(row, ids array<int>)`` per row: the row as a struct and the pieces of its ``text``.

    ``key`` (a long; the hash of the text by default) tells texts apart for the
    dropout: equal keys and texts have equal pieces.  Null text has null ids, empty
    text none.  Very long texts and words are encoded whole.  Rows may repeat.  An
    empty table gives no rows; other columns are in ``row`` untouched.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in blocks(with_fields(batch, "text"), "text", BLOCK_BYTES):
            numbers = np.asarray(part.column("key")).astype(np.int64).view(np.uint64)
            keys = _mix(numbers ^ np.uint64(how.seed * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
            found = encode_texts(shipped.value, part.column("text").to_pylist(), keys, how.share)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.list_(pa.int32()))], names=["row", "ids"])

    number = F.coalesce((F.xxhash64("text") if key is None else key).cast("long"), F.lit(0))
    rows = docs.select(F.struct("*").alias("row"), number.alias("key"))
    return map_arrow(rows, run, row_and(rows, "ids array<int>"))


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """Add ``decoded`` to a table with ``ids``: the text, or null for null ids."""
    shipped = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = (x.values.to_numpy().tolist() if x.is_valid else None for x in batch.column("ids"))
        texts = [decode_ids(shipped.value, x) for x in ids]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return map_arrow(encoded, run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
