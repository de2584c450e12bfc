"""Numpy helpers for tasks: words and hashes of a whole Arrow batch of texts at once, in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that a task handles at once; one text that is longer makes a piece of its own.
PIECE_BYTES = 1 << 20


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


#: Words between white space (space, tab to carriage return).
SPACED = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Words of ASCII letters, digits and anything beyond ASCII.
WORDY = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Of a block of 8 bytes, those that belong to a span with so many bytes left.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Piece(NamedTuple):
    first: int  #: row of the batch that comes first
    data: np.ndarray  #: UTF-8 bytes of the rows
    bounds: np.ndarray  #: where each row begins, and the end


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  #: where each row's words begin, and the end
    hashes: np.ndarray


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """The column in runs of rows of about `most` bytes."""
    data, bounds = text_buffer(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        yield Piece(row, data[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row])
        row = last


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, ASCII lower-cased first if asked for. Spans are in order and not empty.

    Blocks of 8 bytes are mixed with their place in the span before they are added, so no exchange of blocks or letters
    keeps the sum; of spans of up to 8 bytes different ones differ.
    """
    hashes = np.empty(len(starts), np.uint64)
    w = 0
    while w < len(starts):  # a very long text is hashed in stretches of whole words
        last = max(w + 1, int(np.searchsorted(ends, starts[w] + 4 * PIECE_BYTES, "right")))
        part = data[starts[w] : ends[last - 1]]
        part = np.concatenate([LOWER[part] if lower else part, np.zeros(8, np.uint8)])
        lengths = ends[w:last] - starts[w:last]
        blocks = (lengths + 7) >> 3
        firsts = np.cumsum(blocks) - blocks
        place = np.arange(int(blocks.sum())) - np.repeat(firsts, blocks)
        bits = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))[np.repeat(starts[w:last] - starts[w], blocks) + 8 * place]
        bits &= _LEFT[np.minimum(np.repeat(lengths, blocks) - 8 * place, 8)]
        keys = mixed((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        hashes[w:last] = mixed(np.add.reduceat(mixed(bits ^ keys), firsts) + lengths.astype(np.uint64))
        w = last
    return hashes


def words(piece: Piece, kind: np.ndarray, lower: bool = True, seed: int = 0) -> Words:
    """Maximal runs of bytes of a kind within each row, with a 64-bit hash of each, ASCII lower-cased first."""
    data, bounds = piece.data, piece.bounds
    inside = kind[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins[inner] = inside[inner]
    finishes[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    rows = np.searchsorted(starts, bounds)
    return Words(starts, ends, rows, span_hashes(data, starts, ends, lower, seed))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each stretch, one stretch after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and each row's length."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
