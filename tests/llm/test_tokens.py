import zlib
from collections import defaultdict

import numpy as np
import pytest

from quern.llm.op03_packing import Encoder, pack_documents, pieces, tokenizer
from quern.llm.op06_token_counts import count_tokens
from quern.llm.queries import op3_packing, op6_token_counts, vocabulary
from quern.session import table

from .cases import AWKWARD, awkward, empty, with_clashes

SF = "/root/testdata/sf0.001"


def encoded(name, texts):
    return [x.ids for x in tokenizer(vocabulary(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_pieces_are_powers_of_two(n):
    got = pieces(n, 1024)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= 1024 for x in got) and got == sorted(got, reverse=True)


def test_packing_round_trip(spark):
    docs = with_clashes(awkward(spark)).filter("doc_id is not null and doc_id <> 10")
    rows = pack_documents(docs, vocabulary("byte_bpe_50k.json")).collect()
    want = {r[0]: ids + [0] for r, ids in zip(AWKWARD, encoded("byte_bpe_50k.json", [r[1] for r in AWKWARD]), strict=True)}
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got[r.doc_id]) and r.offset == 0 and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        assert r.length & (r.length - 1) == 0 and len(r.ids) == 4 * r.length
    assert dict(got) == {k: want[k] for k in got} and len(got) == 10
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_packing_repeated_null_and_empty(spark):
    rows = pack_documents(awkward(spark), vocabulary("byte_bpe_50k.json")).collect()
    assert sum(r.start == 0 for r in rows) == len(AWKWARD)
    assert pack_documents(empty(spark), vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_query_against_the_library(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    ids = dict(zip(docs, encoded("byte_bpe_50k.json", docs.values()), strict=True))
    rows = op3_packing(spark, SF).collect()
    for r in rows:
        piece = np.array((ids[r.doc_id] + [0])[r.start : r.start + r.length], "<u4").tobytes()
        assert len(piece) == 4 * r.length and zlib.crc32(piece) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in ids.values())
    batches = defaultdict(list)
    for r in rows:
        assert r.length == 1 << r.bucket
        batches[r.bucket, r.batch].append(r.length)
    assert all(sum(b) <= 65_536 for b in batches.values())


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, model):
        self.model, self.texts = model, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.model.encode_batch_fast(texts, **how)


def test_new_chunks_are_encoded_many_at_once():
    chunks = [f" w{k}ord" for k in range(2000)] + ["<|endoftext|>", " a<|endoftext|>b", "<|endof", "text|>", "<|endoftext|", ">", "", " ", "\n", "é\u3000", "🙂 "] + [f"{k}\n" for k in range(2000)]
    want = [np.array(x, "=u4").tobytes() for x in encoded("byte_bpe_50k.json", chunks)]
    of = Encoder(vocabulary("byte_bpe_50k.json"))
    of.model = Counting(of.model)
    assert of.of(chunks) == want and of.model.texts < len(chunks) / 10
    before = of.model.texts
    assert of.of(chunks[::-1]) == want[::-1] and of.model.texts == before
    of.between, of.young = None, {}
    assert of.of(chunks) == want


def test_token_counts_against_the_library(spark):
    rows = count_tokens(with_clashes(awkward(spark)), vocabulary("word_bpe_49k.json")).collect()
    want = [(r[0], len((r[1] or "").encode()), len(ids)) for r, ids in zip(AWKWARD, encoded("word_bpe_49k.json", [r[1] for r in AWKWARD]), strict=True)]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in rows], key=key) == sorted(want, key=key)
    assert count_tokens(empty(spark), vocabulary("word_bpe_49k.json")).count() == 0


def test_token_count_query_against_the_library(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    want = {d: len(x) for d, x in zip(docs, encoded("word_bpe_49k.json", docs.values()), strict=True)}
    rows = op6_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want and all(r.over_limit == (r.n_tokens > 2048) for r in rows)
