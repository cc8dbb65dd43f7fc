"""Splitting whole Arrow text columns into words with array arithmetic.

All operators that need words of whole corpora share this: the bytes of a
column slice are classified through a 256-entry table, so a slice costs a few
passes over its bytes instead of a Python call per word.  Only ASCII bytes act
as separators or are lower-cased; bytes of 128 and over always stay, so UTF-8
is never broken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text that are worked on at once; bounds a worker's memory.
SLICE_ROWS, SLICE_BYTES = 16_384, 8_000_000


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


#: space, tab to carriage return
BLANKS = byte_set((0x20, 0x20), (0x09, 0x0D))
#: everything in ASCII but digits and letters
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: A-Z to a-z, all else as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: all as it is
SAME = np.arange(256, dtype=np.uint8)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded rows and bytes; one row is never cut.
    Memory that a batch's slices took goes back before the next batch."""
    for batch in batches:
        _, at = raw(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + max_bytes, side="right")) - 1
            last = min(max(last, first + 1), first + max_rows, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
        del batch
        pa.default_memory_pool().release_unused()


def parts(texts: pa.Array, separators: np.ndarray, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[tuple[int, pa.LargeStringArray]]:
    """The texts in bounded parts: (number of the part's first row, texts).

    Only a text of more than max_bytes is cut, before a separator, so no word is;
    its parts follow each other and have one row each.  A null is empty.
    """
    data, at = raw(texts)
    text = lambda bounds: pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.asarray(bounds, np.int64) - bounds[0]), pa.py_buffer(data[bounds[0] : bounds[-1]]))
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + max_bytes, side="right")) - 1
        if last > first:
            last = min(last, first + max_rows)
            yield first, text(at[first : last + 1])
            first = last
            continue
        begin, end = int(at[first]), int(at[first + 1])
        while begin < end:
            cut = begin + max_bytes
            while cut < end and not separators[data[cut]]:
                ahead = np.flatnonzero(separators[data[cut : min(cut + 4096, end)]])
                cut = cut + int(ahead[0]) if len(ahead) else cut + 4096
            cut = min(cut, end)
            yield first, text([begin, cut])
            begin = cut
        first += 1


def counted(flags: np.ndarray) -> np.ndarray:
    """How many flags are set up to each place."""
    return np.cumsum(flags, dtype=np.int32 if len(flags) < 1 << 31 else np.int64)


def split_words(texts: pa.Array, separators: np.ndarray, cases: np.ndarray = LOWER) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Lower-cased words of all rows in order, and the offsets of each row's words.
    cases: what becomes of each byte."""
    data, at = raw(texts)
    word = ~separators[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    rows = at[:-1][at[1:] > at[:-1]]
    start[rows] = word[rows]
    begins = np.flatnonzero(start)
    kept = cases[data[word]]
    offsets = np.append(counted(word)[begins] - 1, len(kept)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(kept))
    return words, np.searchsorted(begins, at)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's number, and the distinct words by number."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


class Tally:
    """Words, distinct words and words that repeat the one before, by row of texts that come in parts."""

    def __init__(self, rows: int):
        self.words, self.distinct, self.repeated = (np.zeros(rows, np.int64) for _ in range(3))
        self.row, self.seen, self.last = -1, None, None

    def add(self, first: int, texts: pa.Array, separators: np.ndarray) -> None:
        found, offsets = split_words(texts, separators, SAME)
        codes, names = coded(found)
        rows = slice(first, first + len(texts))
        row = row_of(offsets)
        self.words[rows] += np.diff(offsets)
        again = np.flatnonzero((codes[1:] == codes[:-1]) & (row[1:] == row[:-1]))
        self.repeated[rows] += np.bincount(row[again], minlength=len(texts))
        if len(texts) == 1:
            # perhaps a part of a long text: words of its other parts count once
            goes_on = first == self.row
            self.repeated[first] += bool(goes_on and len(found) and self.last == found[0])
            self.seen = pc.unique(pa.concat_arrays([self.seen, names])) if goes_on else names
            self.last = found[-1] if len(found) else self.last if goes_on else None
            self.row, self.distinct[first] = first, len(self.seen)
        elif len(codes):
            keys = np.sort(row * len(names) + codes)
            self.distinct[rows] += np.bincount(keys[np.append(True, keys[1:] != keys[:-1])] // len(names), minlength=len(texts))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each word, from the rows' word offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
