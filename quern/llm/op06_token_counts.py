"""Exact token counts without token ids.

The library's own normaliser and pre-tokenizer split texts into pre-tokens,
pieces are counted once per distinct pre-token of the whole corpus, and a
document's count is the sum of frequency * pieces over its pre-tokens, found
by joining its frequencies with that table: the most frequent pre-tokens by
broadcast, all others as postings (see postings.py).  No ids are built.

Null text counts as empty.  Every row is counted by itself, repeated ids and
null ids included; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.op03_packing import tokenizer
from quern.llm.postings import Head, document_key, posting_batch, slice_numbers, slice_sums
from quern.llm.words import BLANKS, SLICE_ROWS, counted, raw, row_of, slices
from quern.session import stash

#: Distinct chunks that a worker remembers, in each of two generations.
REMEMBERED = 250_000
#: A special token of the vocabulary; no pre-token can hold a space.
SPECIAL = " special"


def ascii_chunks(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs without ASCII white space, as they are, and the rows' offsets.

    Neither the normaliser (composition, lower case per character) nor the
    pre-tokens of a white-space-dropping vocabulary reach across such a cut.
    """
    data, at = raw(texts)
    word = ~BLANKS[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    rows = at[:-1][at[1:] > at[:-1]]
    start[rows] = word[rows]
    begins = np.flatnonzero(start)
    kept = data[word]
    offsets = np.append(counted(word)[begins] - 1, len(kept)).astype(np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(kept))
    return chunks.dictionary_encode(), np.searchsorted(begins, at)


class PreTokens:
    """Pre-tokens of chunks as the library at path makes them."""

    def __init__(self, path: str):
        self.model = tokenizer(path)
        special = sorted((t.content for t in self.model.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, list[str]] = {}
        self.old: dict[str, list[str]] = {}

    def plain(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        if self.model.normalizer is not None:
            text = self.model.normalizer.normalize_str(text)
        return self.model.pre_tokenizer.pre_tokenize_str(text)

    def of(self, chunk: str) -> list[str]:
        parts, last = [], 0
        for m in self.special.finditer(chunk) if self.special else ():
            parts += [t for t, _ in self.plain(chunk[last : m.start()])] + [SPECIAL]
            last = m.end()
        return parts + [t for t, _ in self.plain(chunk[last:])]

    def all(self, chunks: list[str]) -> list[list[str]]:
        known, old, new = self.known, self.old, []
        for c in chunks:
            if c not in known:
                if c in old:
                    known[c] = old[c]
                else:
                    new.append(c)
        odd = [c for c in new if not c.isascii() and any(x.isspace() for x in c) or self.special and self.special.search(c)]
        for c in odd:
            known[c] = self.of(c)
        even = [c for c in new if c not in known] if odd else new
        for k in range(0, len(even), 2000):
            # Pre-tokens cover a chunk without gaps, so a gap in the offsets ends it.
            part, groups, end = even[k : k + 2000], [], -1
            for token, (first, last) in self.plain(" ".join(part)):
                if first != end:
                    groups.append([])
                groups[-1].append(token)
                end = last
            if len(groups) != len(part):
                groups = [self.of(c) for c in part]
            known.update(zip(part, groups, strict=True))
        out = [known[c] for c in chunks]
        if len(known) > REMEMBERED:
            self.old, self.known = known, {}
        return out


@lru_cache(maxsize=1)
def pre_tokens(path: str) -> PreTokens:
    """One for all tasks of a worker."""
    return PreTokens(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def occurrences(split: PreTokens, part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens of a slice, and of each pre-token and row that
        meet: the pre-token's number, the row and how often (in parts)."""
        chunks, offsets = ascii_chunks(part.column("text"))
        tokens = split.all(chunks.dictionary.to_pylist())
        # chunks are counted by row first, then spread to their pre-tokens
        codes = chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, n = np.unique(codes * part.num_rows + row_of(offsets), return_counts=True)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = pa.array([t for x in tokens for t in x], pa.large_string()).dictionary_encode()
        code, row = pair // max(part.num_rows, 1), pair % max(part.num_rows, 1)
        each = sizes[code]
        ends = np.cumsum(each)
        firsts = np.cumsum(sizes) - sizes
        place = np.repeat(firsts[code] - ends + each, each) + np.arange(int(ends[-1]) if len(ends) else 0)
        return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)[place], np.repeat(row, each), np.repeat(n, each)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            chunks, _ = ascii_chunks(part.column("text"))
            tokens = pre_tokens(tokenizer_path).all(chunks.dictionary.to_pylist())
            n = np.bincount(chunks.indices.to_numpy(zero_copy_only=False), minlength=len(tokens))
            flat = pa.array([t for x in tokens for t in x], pa.string()).dictionary_encode()
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            words = flat.dictionary
            total = np.bincount(flat.indices.to_numpy(zero_copy_only=False), np.repeat(n, sizes), len(words)).astype(np.int64)
            for k in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([words[k : k + 20_000], pa.array(total[k : k + 20_000])], ["word", "n"])

    def with_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(tokenizer_path).model
        for batch in batches:
            words = batch.column("word")
            n = [1 if w == SPECIAL else len(model.tokenize(w)) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, batch.column("n"), pa.array(n, pa.int32())], ["word", "n", "pieces"])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = slice_numbers()
        names = ["word", "slice", "entries", "key", "doc_id", "n_bytes", "n_tokens"]
        for part in slices(batches, "text"):
            slice_no = next(numbers)
            words, code, row, n = occurrences(pre_tokens(tokenizer_path), part)
            known, pieces = head.value.of(words)
            own = np.bincount(row, pieces[code] * n, part.num_rows).astype(np.int64)
            rest = ~known[code]
            words, slice_col, blob = posting_batch(words, code[rest], row[rest], n[rest], slice_no)
            words = words.cast(pa.string())
            for k in range(0, len(words), 20_000):
                w = words[k : k + 20_000]
                none = pa.nulls(len(w), pa.int64())
                yield pa.RecordBatch.from_arrays([w, slice_col[k : k + 20_000], blob[k : k + 20_000], none, none, none, none], names)
            _, at = raw(part.column("text"))
            keys = document_key(slice_no, part.num_rows)
            # a key with a space is no pre-token
            label = pa.array([f" {k}" for k in keys.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([label, pa.array(np.full(len(keys), slice_no)), pa.nulls(len(keys), pa.binary()), pa.array(keys), part.column("doc_id"), pa.array(np.diff(at)), pa.array(own)], names)

    def totals(joined: pa.Table) -> pa.Table:
        about = joined.column("key").is_valid()
        own, rest = joined.filter(about), joined.filter(pc.invert(about))
        (more,) = slice_sums(rest, [rest.column("pieces").to_numpy()])
        row = own.column("key").to_numpy() % SLICE_ROWS
        return own.select(["doc_id", "n_bytes"]).append_column("n_tokens", pa.array(own.column("n_tokens").to_numpy() + more[row].astype(np.int64)))

    words = stash(texts.select("text").mapInArrow(frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(with_pieces, "word string, n long, pieces int"), "pieces")
    head = texts.sparkSession.sparkContext.broadcast(Head(words, "pieces"))
    rows = texts.mapInArrow(postings, "word string, slice long, entries binary, key long, doc_id long, n_bytes long, n_tokens long")
    joined = rows.join(words.drop("n"), "word", "left").select("slice", "entries", "pieces", "key", "doc_id", "n_bytes", "n_tokens")
    return joined.groupBy("slice").applyInArrow(totals, "doc_id long, n_bytes long, n_tokens long")
