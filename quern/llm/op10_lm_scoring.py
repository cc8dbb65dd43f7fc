"""Language-model scoring by partial matching over a byte-context trie.

The trie holds, for contexts of up to four bytes, how often each byte follows
in the training documents (lower-cased A-Z; four start marks before a text, an
end mark after it).  Escapes are estimated by the number of distinct symbols of
a context (method C), and symbols of a longer context are excluded from the
shorter ones.  All training documents are counted.

Contexts of three and four bytes, which grow with the corpus, are a Spark table
of counted grams (a context of four and its symbol); contexts of up to two have
a proven bound of 2**24 nodes and are broadcast.  The trie is pretrained, so a
gram has one code length: grams that end a context of three bytes alike are at
most 2**16 rows, and these are all that the code lengths of its contexts need
(the symbols seen after a context are also seen after its shorter ones, so what
a level excludes is what the level above has seen).  Grams that only other
documents hold are rows of that table with a count of zero.

A document's score is the sum of its grams' code lengths, the most frequent ones
by broadcast, all others by a join (see postings.py).  The base score is an
add-one-half unigram model over words, whose counts meet the documents in the
same join.

Null text counts as empty and still codes its end.  Rows with a null id are
held out and never trained on.  Repeated rows count and score row by row.
Without training documents every symbol costs the same.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.postings import Head, NumberHead, document_key, posting_batch, slice_numbers, slice_sums
from quern.llm.words import BLANKS, LOWER, SLICE_ROWS, coded, raw, row_of, slices, split_words
from quern.session import stash, unstash

#: Marks that are no bytes of UTF-8.
START, END = 0xFE, 0xFF
SYMBOLS = 255  # all bytes but START
ORDER = 4
#: Frequent grams whose code lengths are broadcast.
GRAM_HEAD = 1 << 16
#: Bytes of text that are cut into grams at once, and rows of grams that are valued at once.
GRAM_SLICE, GRAM_ROWS = 2_000_000, 400_000


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol of every row with its four predecessors as 40 bits, and the
    rows' offsets; each row has its bytes and the end mark."""
    data, at = raw(texts)
    sizes = np.diff(at)
    n, wide = len(sizes), ORDER + 1
    marked = np.full(len(data) + wide * n, START, np.uint8)
    marked[np.arange(len(data)) + np.repeat(wide * np.arange(n) + ORDER, sizes)] = LOWER[data]
    ends = at[1:] + wide * np.arange(1, n + 1) - 1
    marked[ends] = END
    whole = len(marked) - ORDER if n else 0
    codes = np.zeros(whole, np.int64)
    for k in range(wide):
        codes <<= 8
        codes |= marked[k : k + whole]
    keep = np.ones(whole, bool)
    for k in range(ORDER):  # symbols that are start marks
        keep[ends[:-1] + k + 1 - ORDER] = False
    return codes[keep], np.append(0, np.cumsum(sizes + 1))


def gram_counts(texts: DataFrame) -> DataFrame:
    """code long, n long (in trained rows), m long (in all) of (text, trained)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, "text"):
            found: list[np.ndarray] = []
            for part in slices(iter([whole]), "text", GRAM_SLICE):
                codes, at = grams(part.column("text"))
                codes = codes << 1 | np.repeat(part.column("trained").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at))
                found.append(np.unique(codes, return_counts=True))
            codes, counts = np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found])
            if len(found) > 1:
                codes, inverse = np.unique(codes, return_inverse=True)
                counts = np.bincount(inverse, counts).astype(np.int64)
            for k in range(0, len(codes), 100_000):
                part, n = codes[k : k + 100_000], counts[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part >> 1), pa.array(n * (part & 1)), pa.array(n)], ["code", "n", "m"])

    return texts.select("text", "trained").mapInArrow(run, "code long, n long, m long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


@dataclass
class LowOrders:
    """Contexts of up to two bytes, as matrices by symbol; row: that of a context
    of two bytes, or of its last byte if it was never seen."""

    row: np.ndarray
    counts: np.ndarray
    below: np.ndarray  # probability after an escape from the two bytes

    @staticmethod
    def of(codes: np.ndarray, n: np.ndarray) -> LowOrders:
        """codes: two bytes and a symbol as 24 bits."""
        context, symbol = codes >> 8, codes & 255
        contexts = np.unique(context)
        order2 = np.zeros((len(contexts) + 256, 256))
        order2[np.searchsorted(contexts, context), symbol] = n
        order1 = np.zeros((256, 256))
        np.add.at(order1, (context & 255, symbol), n)
        order0 = order1.sum(axis=0)
        possible = np.arange(256) != START

        def level(counts: np.ndarray, excluded: np.ndarray, below: np.ndarray) -> np.ndarray:
            """Probabilities of the symbols that are not excluded."""
            own = np.where(excluded, 0, counts)
            total, distinct = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True)
            # nothing can follow an escape if all symbols are excluded or counted
            rest = (possible & ~excluded & (own == 0)).any(axis=1, keepdims=True)
            whole = np.maximum(total + np.where(rest, distinct, 0), 1)
            escape = np.where(total > 0, distinct / whole, 1.0)
            return np.where(own > 0, own / whole, escape * below)

        last = np.append(contexts & 255, np.arange(256))
        below = np.empty(order2.shape)
        for k in range(0, len(last), 1024):
            seen, b = order2[k : k + 1024] > 0, last[k : k + 1024]
            seen1 = seen | (order1[b] > 0)
            seen0 = seen1 | (order0 > 0)
            left = np.maximum((possible & ~seen0).sum(axis=1, keepdims=True), 1)
            zero = level(np.broadcast_to(order0, seen.shape), seen1, np.broadcast_to(1.0 / left, seen.shape))
            below[k : k + 1024] = level(order1[b], seen, zero)
        row = len(contexts) + (np.arange(65536) & 255)
        row[contexts] = np.arange(len(contexts))
        return LowOrders(row, order2, below)

    def code_lengths(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probabilities of grams, sorted by their last three bytes of context
        and then by code; all grams of such a context are there."""
        symbol, three, four = code & 255, code >> 8 & 0xFFFFFF, code >> 8
        new3 = np.append(True, three[1:] != three[:-1])
        new4 = new3 | np.append(True, four[1:] != four[:-1])
        g3, g4 = np.cumsum(new3) - 1, np.cumsum(new4) - 1
        groups3, groups4 = int(g3[-1]) + 1, int(g4[-1]) + 1
        # what is seen after the last three bytes, by symbol
        pair, of = np.unique(g3 * 256 + symbol, return_inverse=True)
        n3 = np.bincount(of, n)
        group, s = pair >> 8, pair & 255
        total3, distinct3 = np.bincount(group, n3, groups3), np.bincount(group, n3 > 0, groups3)
        # the two bytes before the symbol, and of what they have seen the part that is excluded
        low = self.row[three[new3] & 0xFFFF]
        total2, distinct2 = self.counts[low].sum(axis=1), (self.counts[low] > 0).sum(axis=1)
        seen2 = np.bincount(group, np.where(n3 > 0, self.counts[low[group], s], 0), groups3)

        def level(total: np.ndarray, distinct: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """What a count is divided by, and the probability of an escape."""
            whole = np.maximum(total + np.where(seen < SYMBOLS, distinct, 0), 1)
            return whole, np.where(total > 0, distinct / whole, 1.0)

        total4, distinct4 = np.bincount(g4, n, groups4), np.bincount(g4, n > 0, groups4)
        seen3 = np.bincount(g4, np.where(n > 0, n3[of], 0), groups4)
        of3 = g3[new4]
        whole4, out4 = level(total4, distinct4, distinct4)
        whole3, out3 = level(total3[of3] - seen3, distinct3[of3] - distinct4, distinct3[of3])
        whole2, out2 = level(total2 - seen2, distinct2 - distinct3, distinct2)
        c3, c2, escaped = n3[of], self.counts[low[g3], symbol], (out4 * out3)[g4]
        p = np.where(c2 > 0, escaped * c2 / whole2[g3], escaped * out2[g3] * self.below[low[g3], symbol])
        p = np.where(c3 > 0, out4[g4] * c3 / whole3[g4], p)
        return np.log10(np.where(n > 0, n / whole4[g4], p))


def low_orders(counted: DataFrame) -> LowOrders:
    """From gram counts; at most 2**24 nodes reach the driver."""
    found = counted.filter("n > 0").groupBy((F.col("code").bitwiseAND(F.lit(0xFFFFFF))).cast("int").alias("code")).agg(F.sum("n").alias("n")).toArrow()
    return LowOrders.of(found.column("code").to_numpy().astype(np.int64), found.column("n").to_numpy())


def code_lengths(counted: DataFrame) -> DataFrame:
    """code, m, v: log10 probability of each counted gram."""
    low = counted.sparkSession.sparkContext.broadcast(low_orders(counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, m = (np.zeros(0, np.int64) for _ in range(3))

        def out(k: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(code[:k]), pa.array(m[:k]), pa.array(low.value.code_lengths(code[:k], n[:k]))], ["code", "m", "v"])

        for batch in batches:
            code, n, m = (np.append(old, batch.column(c).to_numpy()) for old, c in ((code, "code"), (n, "n"), (m, "m")))
            if len(code) >= GRAM_ROWS:
                three = code >> 8 & 0xFFFFFF
                k = int(np.flatnonzero(three == three[-1])[0])  # the last context may go on
                if k:
                    yield out(k)
                    code, n, m = code[k:], n[k:], m[k:]
        if len(code):
            yield out(len(code))

    three = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFFFF))
    dealt = counted.withColumn("three", three).repartition("three").sortWithinPartitions("three", "code")
    return dealt.select("code", "n", "m").mapInArrow(run, "code long, m long, v double")


def word_counts(texts: DataFrame) -> DataFrame:
    """word string, n long of all rows of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, _ = split_words(part.column("text"), BLANKS)
            codes, distinct = coded(words)
            n = np.bincount(codes, minlength=len(distinct)).astype(np.int64)
            distinct = distinct.cast(pa.string())
            for k in range(0, len(distinct), 20_000):
                yield pa.RecordBatch.from_arrays([distinct[k : k + 20_000], pa.array(n[k : k + 20_000])], ["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_items(codes: np.ndarray) -> pa.Array:
    """A space, which no word holds, and the five bytes of each gram."""
    out = np.full((len(codes), ORDER + 2), 0x20, np.uint8)
    out[:, 1:] = codes.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer((np.arange(len(codes) + 1) * (ORDER + 2)).astype(np.int32)), pa.py_buffer(out)])


def gram_item(code: Column) -> Column:
    """The same of a column."""
    return F.concat(F.lit(b" "), F.unhex(F.lpad(F.hex(code), 2 * (ORDER + 1), "0")))


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, trained, n_tokens, n_known,
    train_tokens, base_score, score.

    training: which rows the models learn from (null: not).
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("trained"))
    train = texts.filter("trained").select("text")
    counted = stash(gram_counts(texts), "grams")
    lengths = stash(code_lengths(counted), "lengths")
    unstash(counted)
    counts = stash(word_counts(train), "words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    share = texts.sparkSession.sparkContext.broadcast
    head, gram_head = share(Head(counts, "n")), share(NumberHead(lengths, "v", GRAM_HEAD))
    ends = train.count()
    n_train, distinct = int(totals.tokens) + ends, totals.distinct + (ends > 0)
    whole = n_train + 0.5 * (distinct + 1)
    log_p = lambda c: np.log10((c + 0.5) / whole)
    names = ["item", "slice", "entries", "key", "doc_id", "trained", "n_tokens", "score", "n_known", "base_score"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]

    def posted(item: pa.Array, slice_col: pa.Array, blob: pa.Array) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(item), 20_000):
            columns = [item[k : k + 20_000].cast(pa.binary()), slice_col[k : k + 20_000], blob[k : k + 20_000]]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), t) for t in kinds[3:])], names)

    def gram_sums(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's sum over frequent grams; all other grams and their rows."""
        score, rare, rows, first = np.zeros(part.num_rows), [], [], 0
        for x in slices(iter([part]), "text", GRAM_SLICE):
            codes, at = grams(x.column("text"))
            known, value = gram_head.value.of(codes)
            row = first + np.repeat(np.arange(x.num_rows), np.diff(at))
            score[first : first + x.num_rows] = np.add.reduceat(value, at[:-1])
            rare.append(codes[~known])
            rows.append(row[~known])
            first += x.num_rows
        return score, np.concatenate(rare), np.concatenate(rows)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = slice_numbers()
        for part in slices(batches, "text"):
            slice_no = next(numbers)
            words, offsets = split_words(part.column("text"), BLANKS)
            codes, distinct = coded(words)
            rows = row_of(offsets)
            known, c = head.value.of(distinct)
            frequent = known[codes] if len(distinct) else np.zeros(0, bool)
            n_known = np.bincount(rows[frequent], minlength=part.num_rows) + (ends > 0)
            base = np.bincount(rows[frequent], log_p(c)[codes[frequent]], part.num_rows) + log_p(ends)
            yield from posted(*posting_batch(distinct, codes[~frequent], rows[~frequent], None, slice_no))
            n_tokens = np.diff(offsets) + 1
            del words, codes, rows, frequent
            score, rare, rows = gram_sums(part)
            used, codes = np.unique(rare, return_inverse=True)
            yield from posted(*posting_batch(gram_items(used), codes, rows, None, slice_no))
            keys = document_key(slice_no, part.num_rows)
            # a key with a space in front is no word and, by its length, no gram
            label = pa.array([f"  {k:012d}" for k in keys.tolist()], pa.string()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([label, pa.array(np.full(len(keys), slice_no)), pa.nulls(len(keys), pa.binary()), pa.array(keys), part.column("doc_id"), part.column("trained"), pa.array(n_tokens), pa.array(score), pa.array(n_known), pa.array(base)], names)

    def summed(joined: pa.Table) -> pa.Table:
        about, gram = joined.column("key").is_valid(), joined.column("v").is_valid()
        own, spelt = joined.filter(about), joined.filter(gram)
        rest = joined.filter(pc.invert(pc.or_(about, gram)))
        row = own.column("key").to_numpy() % SLICE_ROWS
        c = rest.column("n").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        n_known, base = slice_sums(rest, [c > 0, log_p(c)])
        (score,) = slice_sums(spelt, [spelt.column("v").to_numpy()])
        out = own.select(["doc_id", "trained", "n_tokens"])
        for name, more in (("n_known", n_known.astype(np.int64)), ("base_score", base), ("score", score)):
            out = out.append_column(name, pa.array(own.column(name).to_numpy() + more[row]))
        return out

    rows = texts.mapInArrow(postings, "item binary, slice long, entries binary, key long, doc_id long, trained boolean, n_tokens long, score double, n_known long, base_score double")
    values = counts.select(F.col("word").cast("binary").alias("item"), "n", F.lit(None).cast("double").alias("v")).union(lengths.select(gram_item(F.col("code")), F.lit(None).cast("long"), "v"))
    joined = rows.join(values, "item", "left").select("slice", "entries", "n", "v", "key", "doc_id", "trained", "n_tokens", "score", "n_known", "base_score")
    scored = joined.groupBy("slice").applyInArrow(summed, "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "trained", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
