"""Arrow text columns as byte arrays, and words in them, without row loops.

White space is the six ASCII characters ``[\\x20\\x09-\\x0D]``; a word is a
maximal run of anything else.  Working on UTF-8 bytes is exact for that
definition, as no byte of a longer UTF-8 sequence is below 0x80.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is one piece.
PIECE_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, or one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): all texts one after the other; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    off = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each word; no word crosses a text's end."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off[:-1]] = True
    first = first[:-1]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | first))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = word[1:] & ~first[1:]
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept between calls."""
    if len(_POWERS[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, inverse)):
                grown = np.full(size, base, np.uint64)
                grown[0] = 1
                _POWERS[i] = np.cumprod(grown)
    return _POWERS[0][:n], _POWERS[1]


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each of some byte spans: a difference of running sums."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[raw] * power[:-1], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def windows(word: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of each n-word window within a text."""
    if len(word) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    with np.errstate(over="ignore"):
        value = np.zeros(len(word) - n + 1, np.uint64)
        for j in range(n):
            value = (value ^ word[j : len(word) - n + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
            value ^= value >> np.uint64(32)
        return mix(value[inside]), inside


def take_spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[0]..+size[0], start[1]..+size[1], ... in one array."""
    total = int(size.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(start - (np.cumsum(size) - size), size)


def distinct(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(the distinct spans in byte order, the number of each span in that list).

    Spans are told apart by hash and then compared byte for byte; should two
    ever share a hash, they are told apart by value instead.
    """
    view, size = raw.tobytes(), end - start
    _, first, number = np.unique(span_hash(raw, start, end), return_index=True, return_inverse=True)
    like = first[number]
    if (size != size[like]).any() or (raw[take_spans(start, size)] != raw[take_spans(start[like], size)]).any():
        words = [view[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        found = sorted(set(words))
        place = dict(zip(found, range(len(found)), strict=True))
        return found, np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    found = [view[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    order = sorted(range(len(found)), key=found.__getitem__)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return [found[i] for i in order], place[number]
