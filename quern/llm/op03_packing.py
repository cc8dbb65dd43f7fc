"""Packing by power-of-two decomposition.

A document of n tokens (its ids and one end id) is cut into floor(n / 1024)
pieces of 1024 and, for the rest, one piece per set bit of its length.  Every
piece has a length that is a power of two and is a sequence of its own: pieces
of one length form a bucket whose batches need no padding, and no sequence
crosses documents.  A task deals the pieces of each bucket to batches of
``batch_tokens`` tokens; only the last batch of a task and bucket holds fewer.

Null text counts as empty (one piece: the end id).  Repeated rows and null ids
are packed row by row.  An empty table gives an empty result.  Columns other
than the id and the text are neither needed nor kept.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import byte_set, raw, slices

#: Distinct chunks whose ids a worker remembers, in each of two generations.
REMEMBERED = 50_000
#: Chunks that the library gets as one text, with a special token between them.
JOINED = 32
#: First bytes of the characters beyond ASCII that can be white space.
SPACE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A))
MARKS = byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def chunk_starts(data: np.ndarray, at: np.ndarray, marks: np.ndarray = MARKS) -> np.ndarray:
    """Where a text may be cut without changing its pre-tokens.

    A byte-level pre-token holds white space only at its front or holds nothing
    else, so a cut is safe before a space that something else than white space
    follows, and before a line feed that follows something else.  Neither does
    a pre-token hold a letter with a mark after it, so a cut between them is
    safe, too (letters here: ASCII and those of the block after it; marks must
    not occur in special tokens).  Where a byte beyond ASCII might be white
    space, there is no cut.
    """
    n = len(data)
    start = np.zeros(n + 1, bool)
    if n:
        solid = data > 0x20
        solid &= ~np.isin(data, SPACE_LEADS) & (data != 0x7F)
        start[:-2] |= (data[:-1] == 0x20) & solid[1:]
        start[1:-1] |= (data[1:] == 0x0A) & solid[:-1] & (data[:-1] < 0x80)
        letter = LETTERS[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        start[1:-1] |= letter[:-1] & marks[data[1:]]
    start[at] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids by the library, each distinct chunk encoded once while it is remembered.

    Chunks that come again move to the young generation, so frequent ones stay.
    """

    def __init__(self, path: str):
        self.model = tokenizer(path)
        self.marks = MARKS.copy()
        for token in self.model.get_added_tokens_decoder().values():
            self.marks[list(token.content.encode())] = False
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.between = None
        if self.model.normalizer is None and len(added := self.model.get_added_tokens_decoder()) == 1:
            ((number, token),) = added.items()
            overlaps = any(token.content.startswith(token.content[k:]) for k in range(1, len(token.content)))
            if not (token.lstrip or token.rstrip or token.single_word or overlaps):
                self.between = number, token.content

    def encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk.

        The library takes a text apart at special tokens before anything else, so chunks
        are encoded many at once with one between them, unless a chunk holds it, or it
        could overlap with a chunk, change beside one or be one of several.
        """
        one_by_one = lambda some: [array("I", found.ids).tobytes() for found in self.model.encode_batch_fast(some, add_special_tokens=False)]
        if self.between is None:
            return one_by_one(chunks)
        number, token = self.between
        out = []
        texts = [token.join(chunks[k : k + JOINED]) for k in range(0, len(chunks), JOINED)]
        for k, (text, found) in enumerate(zip(texts, self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True)):
            some = chunks[k * JOINED : (k + 1) * JOINED]
            ids = np.array(found.ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == number), len(ids))
            if not text.count(token) == len(ends) - 1 == len(some) - 1:
                out += one_by_one(some)
                continue
            whole, ends = ids.tobytes(), (4 * ends).tolist()
            out += [whole[first:last] for first, last in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)]
        return out

    def of(self, chunks: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        out, new = list(map(young.get, chunks)), []
        for k, found in enumerate(out):
            if found is None:
                found = old.get(chunks[k])
                if found is None:
                    new.append(k)
                else:
                    out[k] = young[chunks[k]] = found
        for first in range(0, len(new), 4096):
            part = new[first : first + 4096]
            for k, found in zip(part, self.encoded([chunks[k] for k in part]), strict=True):
                out[k] = young[chunks[k]] = found
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
        return out

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order and the offsets of the rows' ids."""
        data, at = raw(texts)
        begins = chunk_starts(data, at, self.marks)
        offsets = np.append(begins, len(data)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        ids = self.of(chunks.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), "=u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        firsts = np.cumsum(sizes) - sizes
        codes = chunks.indices.to_numpy(zero_copy_only=False)
        each = sizes[codes]
        ends = np.cumsum(each)
        out = flat[np.repeat(firsts[codes] - ends + each, each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out.astype("<u4", copy=False), np.append(0, ends)[np.searchsorted(begins, at)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def pieces(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens, longest first; longest is a power of two."""
    return [longest] * (n // longest) + [1 << k for k in reversed(range(longest.bit_length() - 1)) if n % longest >> k & 1]


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence_length: int = 1024, end_id: int = 0, batch_tokens: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian
    unsigned 32-bit), sequence_id, offset, bucket (binary logarithm of the length),
    batch (number of its batch among those of the bucket).

    tokenizer_path is the vocabulary file as the executors see it.  The work is
    one pass without a shuffle; sequence_id numbers the pieces by partition.
    """
    if sequence_length < 1 or sequence_length & (sequence_length - 1):
        raise ValueError("sequence_length has to be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        dealt: dict[int, int] = {}
        base = TaskContext.get().partitionId() << 33
        for part in slices(batches, "text", 3_000_000):
            ids, at = encoder(tokenizer_path).rows(part.column("text"))
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, first, last in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                whole, start = ids[first:last].tobytes() + end, 0
                n = last - first + 1
                for length in pieces(n, sequence_length):
                    for column, value in zip(out, (doc_id, start, length, n, whole[4 * start : 4 * (start + length)]), strict=True):
                        column.append(value)
                    start += length
            for k in range(0, len(out[0]), 5000):
                columns = [pa.array(c[k : k + 5000], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                lengths = columns[2].to_numpy()
                batch = np.empty(len(lengths), np.int64)
                for length in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == length)
                    first = dealt.get(length, 0)
                    batch[own] = base + (first + np.arange(len(own))) // max(1, batch_tokens // length)
                    dealt[length] = first + len(own)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(batch)], ["doc_id", "start", "length", "doc_tokens", "ids", "batch"])

    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, batch long")
    return packed.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})
