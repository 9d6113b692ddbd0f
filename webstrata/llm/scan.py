"""Words of Arrow string columns by vectorised scans of their buffers: byte classes, prefix sums and verified word hashes.

A column is taken apart into pieces of about PIECE bytes, whole texts together or a long text's parts, cut between words, so
scratch memory is a multiple of PIECE (or of one word, if that is longer), whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
#: Base of the word hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 byte values lie in one of the ranges, ends included."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Words between white space, and words of letters and digits (all that isn't ASCII counts as a letter), by their bytes.
BETWEEN_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = ~byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin (one more than rows); null is empty. No bytes are copied but for nulls."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, "i8" if wide else "i4", len(column) + 1, column.offset * (8 if wide else 4)).astype("i8") if len(column) else np.zeros(1, "i8")
    return (np.frombuffer(data, "u1") if data else np.zeros(0, "u1"))[at[0] : at[-1]], at - at[0]


@dataclass
class Piece:
    """A run of bytes with the rows that they belong to: row `first + i` has bytes[at[i]:at[i + 1]]."""

    data: np.ndarray
    at: np.ndarray
    first: int
    place: int  # of the first byte in the whole column

    def words(self, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row (from 0) of each word: the longest runs of bytes that `letter` marks, within a row."""
        return self.words_in(self.data, letter)

    def words_in(self, data: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of other bytes in place of the piece's."""
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = letter[data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.at] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        return starts, ends, np.searchsorted(self.at, starts, "right") - 1

    def counts(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each row a table marks, by prefix sums."""
        sums = np.zeros(len(self.data) + 1, "i8")
        np.cumsum(marked[self.data], out=sums[1:])
        return np.diff(sums[self.at])


def pieces(data: np.ndarray, at: np.ndarray, letter: np.ndarray, size: int = PIECE) -> Iterator[Piece]:
    """All bytes of a column once and in order. A row of more than `size` bytes is cut behind bytes that are in no word."""
    row, rows = 0, len(at) - 1
    while row < rows:
        to = max(int(np.searchsorted(at, at[row] + size, "right")) - 1, row + 1)
        if at[to] - at[row] <= size:
            yield Piece(data[at[row] : at[to]], at[row : to + 1] - at[row], row, int(at[row]))
        else:
            start, end = int(at[row]), int(at[row + 1])
            while start < end:
                stop, step = min(start + size, end), size
                while stop < end:  # back to the last byte that is in no word, or on to the first
                    gap = np.flatnonzero(~letter[data[start:stop]])
                    if len(gap):
                        stop = start + int(gap[-1]) + 1
                        break
                    step *= 2
                    stop = min(start + step, end)
                yield Piece(data[start:stop], np.array([0, stop - start]), row, start)
                start = stop
        row = to


class Powers:
    """Powers of BASE and of its inverse, as many as were ever needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, "u8")

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(n, BASE, "u8"), np.full(n, INVERSE, "u8")
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.cumprod(s, dtype="u8") for s in steps)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial; equal words have equal hashes wherever they stand."""
    up, down = POWERS(len(data) + 1)
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= (ends - starts).astype("u8") << np.uint64(48)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def same_words(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether words left[a:a+length] and right[b:b+length] have the same bytes."""
    if not len(a):
        return np.zeros(0, bool)
    before = np.cumsum(length) - length
    inner = np.arange(int(length.sum())) - np.repeat(before, length)
    differ = left[np.repeat(a, length) + inner] != right[np.repeat(b, length) + inner]
    return np.add.reduceat(differ, before) == 0 if len(differ) else np.ones(len(a), bool)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word of each row, from word hashes sorted by row and compared byte by byte where they are equal;
    also the rows in which different words share a hash, whose words are to be told apart otherwise."""
    order = np.lexsort((hashes, row))
    s, r, h = starts[order], row[order], hashes[order]
    size = ends[order] - s
    again = np.zeros(len(order), bool)
    again[1:] = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    later = np.flatnonzero(again)
    fits = size[later] == size[later - 1]
    wrong = [r[later[~fits]]]
    later = later[fits]
    step = 1 << 18  # words at a time, so that the bytes compared are bounded
    for k in range(0, len(later), step):
        own = later[k : k + step]
        ok = same_words(data, s[own - 1], data, s[own], size[own])
        wrong.append(r[own[~ok]])
    return order[~again], np.unique(np.concatenate(wrong))
