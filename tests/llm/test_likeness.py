"""What the pipeline's first stage rejects is learned from all labelled rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm.op07_language_id import SEEN, LanguageModel, doublings, features, learn_likeness

DIMS, SHARE = 64, 0.6


def brute(rows):
    """Means and least likeness by language from distinct rows, on one machine."""
    means, least, counts = {}, [{} for _ in range(DIMS.bit_length())], np.zeros(DIMS.bit_length(), int)
    for lang in sorted({lang for _, _, lang in rows}):
        x = features(pa.array(sorted(t for t, _, of in {(t, k, of) for k, t, of in rows} if of == lang)), DIMS).astype(np.float16).astype(np.float32)
        x = x[x.any(axis=1)]
        mean = x.sum(axis=0, dtype=float)
        means[lang] = mean / max(np.sqrt(mean @ mean), 1e-9)
        near, level = x @ means[lang], doublings(x)
        for k in np.unique(level):
            least[k][lang] = np.quantile(near[level == k], 0.01)
        counts += np.bincount(level, minlength=len(counts))
    out, last = [], 0.0
    for k, by_lang in enumerate(least):
        last = SHARE * min(by_lang.values()) if counts[k] >= SEEN else last
        out.append(last)
    return means, out


def test_likeness_is_learned_from_all_rows(spark):
    """More rows a language than a sample had, some repeated; the last are unlike all before."""
    draw = random.Random(3)
    word = lambda letters: "".join(draw.choices(letters, k=draw.randint(1, 6)))
    text = lambda letters: " ".join(word(letters) for _ in range(draw.randint(0, 12)))
    rows = [(k, text("abcde" if k % 2 else "efghijk"), "en" if k % 2 else "fr") for k in range(6000)]
    rows += [(7000 + k, text("xyz"), "fr") for k in range(100)] + rows[:40] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = learn_likeness(LanguageModel(DIMS), docs, F.lit(True), share=SHARE)
    means, least = brute(rows)
    assert np.allclose(got.means, [means[k] for k in sorted(means)], atol=1e-6)
    assert np.allclose(got.least, least, atol=1e-9)
    unlike = [(1, "a b c", None), (None, "a b c", "en")]
    assert learn_likeness(LanguageModel(DIMS), spark.createDataFrame(unlike, docs.schema), F.lit(True)).means is None
