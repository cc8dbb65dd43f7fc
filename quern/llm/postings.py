"""Per-document sums over a corpus-wide table of values by word.

A document's sum of f(word) * frequency needs values that only the whole
corpus knows, for a vocabulary without a size bound.  The join is done in two
parts.  The HEAD most frequent words, a fixed number, are broadcast with their
values, and their sums are made where the documents are read; so no frequent
word is ever a join key.  All other words are shuffled: each slice of
documents becomes one row per distinct word (its *posting*: which documents of
the slice hold it, how often), postings meet the value table in one join on
the word, and the joined rows go back to their slice, whose documents' sums are
made at once.  A slice has bounded rows and bytes (only a longer document is a
slice of its own), so no group is large, and each document leaves as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import SLICE_ROWS

#: A posting entry: row in slice, frequency.
ENTRY = np.dtype([("row", "<u2"), ("n", "<u2")])
#: Frequent words whose values are broadcast.
HEAD = 1 << 18


class Head:
    """Values of the most frequent words of a table (word, n, value).

    Frequencies are counted in classes of a sixteenth of a doubling; the head
    is as many of the highest classes as have no more than HEAD words.
    """

    def __init__(self, words: DataFrame, value: str):
        level = F.floor(16 * F.log2("n")).cast("int")
        least, total = 1 << 30, 0
        for r in sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect(), reverse=True):
            total += r.c
            if total > HEAD:
                break
            least = r.level
        rows = words.filter(level >= least).select("word", F.col(value).cast("double").alias("v")).toArrow()
        self.words = rows.column("word").combine_chunks().cast(pa.large_string()) if rows.num_rows else pa.array([], pa.large_string())
        self.values = rows.column("v").to_numpy()

    def of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are in the head, and their values (else 0)."""
        at = pc.index_in(distinct, value_set=self.words)
        found = at.is_valid().to_numpy(zero_copy_only=False)
        values = np.zeros(len(distinct))
        values[found] = self.values[at.drop_null().to_numpy()]
        return found, values


class NumberHead:
    """Values of the most frequent numbers of a table (code, m, value), for
    lookups by the million: hash tables without chains, each of which takes what
    found no place in the one before."""

    def __init__(self, numbers: DataFrame, value: str, most: int, bits: int = 20):
        level = F.floor(16 * F.log2("m")).cast("int")
        least, total = 1 << 30, 0
        for r in sorted(numbers.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect(), reverse=True):
            total += r.c
            if total > most:
                break
            least = r.level
        rows = numbers.filter(level >= least).select("code", F.col(value).cast("double").alias("v")).toArrow()
        code, v = rows.column("code").to_numpy(), rows.column("v").to_numpy()
        self.shift, self.tables = 64 - bits, []
        while len(code):
            slot = self.slot(code, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
            keys[slot[first]], values[slot[first]] = code[first], v[first]
            self.tables.append((keys, values))
            left = np.ones(len(code), bool)
            left[first] = False
            code, v = code[left], v[left]

    def slot(self, code: np.ndarray, table: int) -> np.ndarray:
        return (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * table & 0xFFFFFFFFFFFFFFFF) >> np.uint64(self.shift)).view(np.int64)

    def of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the numbers are in the head, and their values (else 0)."""
        found, values = np.zeros(len(code), bool), np.zeros(len(code))
        at = np.arange(len(code))
        for k, (keys, table) in enumerate(self.tables):
            slot = self.slot(code[at], k)
            hit = keys[slot] == code[at]
            found[at[hit]], values[at[hit]] = True, table[slot[hit]]
            at = at[~hit]
        return found, values


def slice_numbers() -> Iterator[int]:
    """Numbers of a task's slices; a task that is run again gives the same."""
    at = TaskContext.get().partitionId() << 27
    while True:
        yield at
        at += 1


def document_key(slice_no: int, rows: int) -> np.ndarray:
    return slice_no * SLICE_ROWS + np.arange(rows, dtype=np.int64)


def posting_batch(words: pa.Array, codes: np.ndarray, rows: np.ndarray, counts: np.ndarray | None, slice_no: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Columns word, slice, entries for one slice.

    codes, rows: of each occurrence; counts: how often it counts, 1 if None.
    """
    key = codes.astype(np.int64) * SLICE_ROWS + rows
    if counts is None:
        key, n = np.unique(key, return_counts=True)
    else:
        key, inverse = np.unique(key, return_inverse=True)
        n = np.bincount(inverse, counts, len(key)).astype(np.int64)
    top = np.iinfo(np.uint16).max
    while len(n) and n.max() > top:  # a frequency beyond 16 bits becomes several entries
        big = np.flatnonzero(n > top)
        key, n = np.append(key, key[big]), np.append(n, n[big] - top)
        n[big] = top
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    entries = np.empty(len(key), ENTRY)
    entries["row"], entries["n"] = key % SLICE_ROWS, n
    code = key // SLICE_ROWS
    begins = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    offsets = (np.append(begins, len(code)) * ENTRY.itemsize).astype(np.int32)
    blob = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(entries.view(np.uint8))])
    return words.take(pa.array(code[begins])), pa.array(np.full(len(begins), slice_no)), blob


def slice_sums(rest: pa.Table, values: list[np.ndarray]) -> list[np.ndarray]:
    """Sums per row of one slice over joined postings (entries, ...).

    values: each posting's value per occurrence.
    """
    blob = rest.column("entries").combine_chunks()
    if not len(blob):
        return [np.zeros(SLICE_ROWS) for _ in values]
    at = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1]
    entries = np.frombuffer(blob.buffers()[2], np.uint8)[at[0] : at[-1]].view(ENTRY)
    repeat = np.diff(at) // ENTRY.itemsize
    return [np.bincount(entries["row"], np.repeat(v, repeat) * entries["n"], SLICE_ROWS) for v in values]
