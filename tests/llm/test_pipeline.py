import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quern.llm.op03_packing import pieces, tokenizer
from quern.llm.op07_language_id import spoken_text
from quern.llm.op09_secrets import masked
from quern.llm.queries import vocabulary
from quern.session import stash, table

from .cases import awkward, empty, with_clashes
from .test_native import brute as leaks
from .test_native import grams, words
from .test_near_dedup import brute as components

SF = "/root/testdata/sf0.001"


#: Long texts in no language of the table.
DRAW = random.Random(5)
FOREIGN = {10_000_000 + k: " ".join("".join(DRAW.choices(letters, k=3 + j % 6)) for j in range(700)) for k, letters in enumerate(["abcdefghijklmnopqrstuvwxyz", "żółćęśąźńkzwyjcp"])}


def test_run_against_brute_force(spark, tmp_path):
    """All stages, also the first one's rejection of texts unlike the table's languages."""
    whole = table(spark, SF, "documents")
    more = spark.createDataFrame(list(FOREIGN.items()), "doc_id long, text string")
    whole.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = {r.doc_id: r.text for r in whole.collect()}
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    docs = {k: t for k, t in docs.items() if spoken_text(t)}
    docs = {k: docs[k] for k, (_, c) in components(docs, 5).items() if k == c}
    held = {g for t in items.values() for g in grams(words(t), 5)}
    suspects = {k: t for k, t in docs.items() if held & set(grams(words(t), 5))}
    gone = {d for d, _ in leaks(suspects, items)}
    docs = {k: masked(t, "[secret]", 1 << 26) for k, t in docs.items() if k not in gone}
    ids = {k: x.ids + [0] for k, x in zip(docs, tokenizer(vocabulary("byte_bpe_50k.json")).encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}
    want = set()
    for k, x in ids.items():
        start = 0
        for n in pieces(len(x), 1024):
            want.add((k, start, n, bytes(np.array(x[start : start + n], "<u4").tobytes())))
            start += n
    before = spark.conf.get(cp.BATCH)
    rows = cp.run(spark, str(tmp_path)).collect()
    assert spark.conf.get(cp.BATCH) == before
    assert {(r.doc_id, r.start, r.length, bytes(r.ids)) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_keep_columns_and_take_awkward_rows(spark, name, stage):
    for docs in (with_clashes(awkward(spark)), empty(spark)):
        out = stage(spark, stash(docs, "in"), SF)
        if name == "packing":
            assert out.filter("start = 0").count() == docs.count()
            continue
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        assert out.count() <= docs.count()


def test_texts_in_no_learned_language_are_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    foreign = [
        "Zażółć gęślą jaźń, a potem wszyscy poszli do domu, ponieważ było już bardzo późno i zimno na dworze tego wieczoru.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "xq zvk wjq ppq zzkx qqw vxz kjq wwz bqx zkq vvq jxk qzw xkv zqj wvk qxz",
        "".join(chr(97 + (k * k * 7 + k // 3) % 26) + " " * (k % 7 == 0) for k in range(400)),
    ]
    more = spark.createDataFrame([(10_000_000 + k, t) for k, t in enumerate(foreign)], "doc_id long, text string")
    kept = {r.doc_id for r in cp.language_id(spark, stash(docs.unionByName(more, allowMissingColumns=True), "in"), "").select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect() if spoken_text(r.text)}


def test_secrets_stage_changes_only_what_holds_secrets(spark):
    docs = spark.createDataFrame([(1, "a clean text", 99), (2, "token = 'abcdefghijklmnop' end", 30), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.secrets(spark, docs, SF).collect()}
    assert got == {1: ("a clean text", 99), 2: ("[secret]' end", 13), 3: (None, None)}
    assert cp.packing(spark, awkward(spark).filter(F.col("doc_id").isNull()), SF).count() > 0
