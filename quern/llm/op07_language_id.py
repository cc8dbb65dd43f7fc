"""Language identification by hierarchical discrimination.

A text's features are hashed byte trigrams of the whole text (lower-cased
A-Z, runs of anything but letters as one blank), square-rooted and scaled to
length one.  First one-versus-rest linear support vector machines choose the
family among those of the learned languages, then one-versus-one linear
support vector machines separate the languages of that family by votes (ties
to the larger sum of margins, then to the smaller name).

Training uses a bounded sample of labelled rows, per_language distinct rows of each
language in expectation, chosen by a hash of id and text, so rows that repeat an id are
chosen each on its own and repeated rows count as one; each machine is fitted by a task
of its own on that sample, and a language is never left without rows.  Only the machines' weights (languages and
their pairs within families, times ``dims``) come to the driver.

A model that was taught to reject (``learn_likeness``) says ``und`` also of texts
unlike all learned languages.  Likeness is the cosine to the nearest language's
mean features; it grows with a text's length, so the least likeness is set for
each doubling of the number of distinct features, at a share of what all but one
in a hundred labelled rows of a language reach.  Means and shares are taken from all
labelled rows, repeated ones counted once.  A length of which there are less than
``SEEN`` rows takes the least likeness of the next shorter one, at first zero: texts
too short to tell stay.

Text that is null or has no letter is ``und`` with score 0, and so is every
text if no labelled row was learned from.  A language without known family is
a family of its own.  Rows with a null id are predicted, never trained on;
repeated rows are predicted row by row.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.words import LOWER, byte_set, raw, slices
from quern.operators.ordering import ordered, running
from quern.session import few, stash, unstash

# Families of languages by their two-letter codes.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "nb", "nn", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
UND = "und"
#: Letters, and some signs that Python's word characters have besides.
LETTER = re.compile(r"[^\W\d_]")
LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
FEATURE_SLICE, FEATURE_ROWS = 2_000_000, 400
SEEN = 10


def spoken_text(text: str | None) -> bool:
    """Whether a text has a letter."""
    return text is not None and any(m[0].isalpha() for m in LETTER.finditer(text))


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), lang)


def features(texts: pa.Array, dims: int) -> np.ndarray:
    """One row of unit length (or zero) per text."""
    data, at = raw(texts)
    n = len(at) - 1
    sizes = np.diff(at)
    out = np.zeros((n, dims), np.float32)
    if not len(data):
        return out
    # a blank after each text, and one for each run without letters
    spaced = np.full(len(data) + n, 0x20, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = np.where(LETTERS[data], LOWER[data], 0x20)
    row = np.repeat(np.arange(n), sizes + 1)
    keep = spaced != 0x20
    keep[1:] |= spaced[:-1] != 0x20
    spaced, row = spaced[keep], row[keep]
    if len(spaced) < 3:
        return out
    wide = spaced.astype(np.uint32)
    code = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)
    inside = row[:-2] == row[2:]
    place = row[2:][inside] * dims + (code[inside] >> np.uint32(32 - dims.bit_length() + 1))
    out = np.sqrt(np.bincount(place, minlength=n * dims).reshape(n, dims)).astype(np.float32)
    length = np.sqrt(np.square(out).sum(axis=1, keepdims=True))
    return out / np.where(length > 0, length, 1)


def doublings(x: np.ndarray) -> np.ndarray:
    """By how many features a row has: 0 for none or one, 1 for two or three, and so on."""
    return np.log2(np.maximum((x > 0).sum(axis=1), 1)).astype(int)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 300) -> np.ndarray:
    """Weights and, last, bias of a linear machine with squared hinge loss; y is 1 or -1.

    Accelerated gradient descent on the whole sample; the classes weigh the same.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = v = np.zeros(x.shape[1])
    step = 1.0 / (1.0 / cost + 4.0)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        gradient = v / cost - 2 * ((weight * y * slack) @ x)
        new = v - step * gradient
        v = new + t / (t + 3.0) * (new - w)
        w = new
    return w


@dataclass
class LanguageModel:
    dims: int
    families: list[str] = field(default_factory=list)
    members: list[list[str]] = field(default_factory=list)
    family_w: np.ndarray | None = None
    pairs: list[list[tuple[int, int]]] = field(default_factory=list)
    pair_w: list[np.ndarray] = field(default_factory=list)
    means: np.ndarray | None = None
    least: np.ndarray | None = None  # by doublings

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        lang, score = np.full(n, UND, object), np.zeros(n)
        spoken = np.array([spoken_text(t) for t in texts.to_pylist()], bool)
        if not self.families or not spoken.any():
            return lang.tolist(), score
        x = features(texts, self.dims)
        if self.means is not None:
            spoken &= (x @ self.means.T).max(axis=1) >= self.least[doublings(x)]
        x = np.hstack([x, np.ones((n, 1), x.dtype)])
        margins = x @ self.family_w.T
        chosen = margins.argmax(axis=1)
        sure = 1 / (1 + np.exp(-4 * margins.max(axis=1))) if len(self.families) > 1 else np.ones(n)
        for f, langs in enumerate(self.members):
            rows = np.flatnonzero(spoken & (chosen == f))
            if not len(rows):
                continue
            votes, sums = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            weakest = np.full((len(rows), len(langs)), np.inf)
            for (a, b), w in zip(self.pairs[f], self.pair_w[f], strict=True):
                m = x[rows] @ w
                for k, own in ((a, m), (b, -m)):
                    votes[:, k] += own > 0
                    sums[:, k] += own
                    weakest[:, k] = np.minimum(weakest[:, k], own)
            best = np.array([max(range(len(langs)), key=lambda k: (v[k], s[k], -k)) for v, s in zip(votes, sums, strict=True)])
            lang[rows] = np.array(langs, object)[best]
            within = weakest[np.arange(len(rows)), best]
            score[rows] = sure[rows] / (1 + np.exp(-4 * within))
        return lang.tolist(), score


def labelled_rows(docs: DataFrame, training: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, text, lang, key (a hash of id and text) of the rows to learn from."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(training & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def language_sizes(rows: DataFrame) -> dict[str, int]:
    """About how many distinct rows a language has."""
    return {r.lang: max(r.n, 1) for r in rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()}


def sampled_rows(rows: DataFrame, sizes: dict[str, int], per_language: int) -> DataFrame:
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, per_language / n)])
    return rows.filter(F.pmod(F.col("key"), F.lit(1_000_003)) / 1_000_003.0 < F.element_at(share, F.col("lang")))


def fit_languages(docs: DataFrame, training: Column, dims: int = 2048, per_language: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from rows where training holds, by their text and language only.

    dims: a power of two.  per_language: expected rows of the sample per language.
    """
    rows = labelled_rows(docs, training, id_col, text_col, lang_col)
    sizes = language_sizes(rows)
    if not sizes:
        return LanguageModel(dims)
    langs = sorted(sizes)
    families = sorted({family_of(x) for x in langs})
    members = [[x for x in langs if family_of(x) == f] for f in families]
    pairs = [list(combinations(range(len(m)), 2)) for m in members]
    # machine -> (language -> side)
    # the machines of two families are each other's mirror image, so one is fitted
    told_apart = [] if len(families) == 1 else families[:1] if len(families) == 2 else families
    machines: list[dict[str, int]] = [{x: 1 if family_of(x) == f else -1 for x in langs} for f in told_apart]
    machines += [{m[a]: 1, m[b]: -1} for m, ps in zip(members, pairs, strict=True) for a, b in ps]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", FEATURE_SLICE, FEATURE_ROWS):
            x = features(part.column("text"), dims).astype(np.float16)
            keys, own = part.column("key").to_pylist(), part.column("lang").to_pylist()
            for k, machine in enumerate(machines):
                at = [r for r, lang in enumerate(own) if lang in machine]
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array([keys[r] for r in at]), pa.array([machine[own[r]] for r in at], pa.int32()), pa.array([x[r].tobytes() for r in at])], ["machine", "key", "side", "x"])

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "side", "x"])
        x = np.frombuffer(b"".join(pdf.x), np.float16).reshape(len(pdf), dims).astype(np.float32)
        return pd.DataFrame({"machine": [pdf.machine.iloc[0]], "w": [fit_svm(x, pdf.side.to_numpy())]})

    found = {}
    if machines:
        sample = sampled_rows(rows, sizes, per_language).mapInArrow(sampled, "machine int, key long, side int, x binary").dropDuplicates(["machine", "key", "side"])
        found = {r.machine: np.array(r.w) for r in sample.groupBy("machine").applyInPandas(fitted, "machine int, w array<double>").collect()}
    if len(found) < len(machines):
        raise ValueError("the sample lacks a language; per_language is too small")
    w = [found[k] for k in range(len(machines))]
    first = len(told_apart)
    family_w = np.array(w[:first] if first != 1 else [w[0], -w[0]]) if first else np.zeros((1, dims + 1))
    rest = iter(w[first:])
    return LanguageModel(dims, families, members, family_w, pairs, [np.array([next(rest) for _ in ps]).reshape(len(ps), dims + 1) for ps in pairs])


def learn_likeness(model: LanguageModel, docs: DataFrame, training: Column, share: float = 0.6, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The model with what it needs to reject texts, from all distinct rows where training
    holds: one pass sums their features by language, a second has each row's likeness to
    its language's mean, of which exact quantiles are taken over range parts."""
    rows = labelled_rows(docs, training, id_col, text_col, lang_col)
    # rows that repeat an id and its text count as one between them
    repeated = stash(rows.groupBy("lang", "key").agg(F.count("*").alias("times")).filter("times > 1"), "repeated")
    weighted = rows.join(few(repeated), ["lang", "key"], "left").select("lang", "text", "times")
    dims, levels = model.dims, model.dims.bit_length()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for part in slices(batches, "text", FEATURE_SLICE, FEATURE_ROWS):
            # sums of so rounded numbers are exact, in whatever order they are taken
            yield part, features(part.column("text"), dims).astype(np.float16).astype(np.float32)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, x in seen(batches):
            own = np.array(part.column("lang").to_pylist(), object)
            weight = 1.0 / part.column("times").fill_null(1).to_numpy()
            for lang in set(own):
                at = own == lang
                sums[lang] = sums.get(lang, 0.0) + weight[at] @ x[at].astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "sums"])

    by_feature = weighted.mapInArrow(summed, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    found = sorted(by_feature.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("sums")).select("lang", F.col("sums.v").alias("sums")).collect())
    unstash(repeated)
    if not found:
        return model
    means = {r.lang: (mean := np.array(r.sums)) / max(np.sqrt(mean @ mean), 1e-9) for r in found}
    shared = docs.sparkSession.sparkContext.broadcast(means)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in seen(batches):
            at = np.flatnonzero(x.any(axis=1))
            near = np.array([x[r] @ shared.value[lang] for r, lang in zip(at, part.column("lang").take(pa.array(at)).to_pylist(), strict=True)], float)
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(at)), part.column("key").take(pa.array(at)), pa.array(doublings(x[at]), pa.int32()), pa.array(near)], ["lang", "key", "level", "near"])

    likeness = stash(rows.select("lang", "key", "text").mapInArrow(compared, "lang string, key long, level int, near double").dropDuplicates(["lang", "key"]).withColumn("one", F.lit(1).cast("long")), "likeness")
    of = ["lang", "level"]
    placed = ordered(likeness, of, ["near", "key"])
    last = likeness.groupBy(*of).agg((F.count("*") - 1).alias("last"))
    at = F.col("last") * 0.01
    around = running(placed, of, i=("sum", "one")).join(F.broadcast(last), of).filter(F.col("i").between(F.floor(at), F.floor(at) + 1))
    edges = around.groupBy(*of, "last").agg(F.sort_array(F.collect_list("near")).alias("near")).collect()
    unstash(likeness, placed)
    least, lowest, counts = np.zeros(levels), np.full(levels, np.inf), np.zeros(levels, int)
    for r in edges:
        # between the two rows around the place that one in a hundred rows lie below
        near = r.near[0] + (r.near[-1] - r.near[0]) * (r.last * 0.01 - np.floor(r.last * 0.01))
        lowest[r.level], counts[r.level] = min(lowest[r.level], near), counts[r.level] + r.last + 1
    for k in range(levels):
        least[k] = share * lowest[k] if counts[k] >= SEEN else least[k - 1] if k else 0.0
    return replace(model, means=np.array([means[r.lang] for r in found], np.float32), least=least)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", FEATURE_SLICE, FEATURE_ROWS):
            lang, score = shared.value.predict(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_column(model: LanguageModel, text: Column) -> Column:
    """struct<lang_pred, score> of a text column, for use beside other columns."""

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for part in slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], ["text"])]), "text", FEATURE_SLICE, FEATURE_ROWS):
            out.append(pd.DataFrame(dict(zip(("lang_pred", "score"), model.predict(part.column("text")), strict=True))))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": pd.Series([], dtype=object), "score": pd.Series([], dtype=float)})

    return run(text)
