"""Quality scores learned from preferences between documents (Bradley-Terry).

A document's strength is a linear function of its features; that one document is
better than another has the logistic of the difference of their strengths as its
probability.  The weights minimise the logistic loss over preference pairs, which
looks at feature differences only.  Here pairs are made of the labels: a document of
label 1 is preferred to one of label 0.

Features of a whole text: shares of bytes by value and of hashed pairs of bytes (both
square-rooted, so rare signs count), distinct words and words that repeat the one
before as shares of all words, mean length of words, size.  They are counted in parts
of bounded bytes, so long texts need no more memory than the words they hold.

Every distinct labelled row is learned from, and every pair of a row of label 1 and one
of label 0: the loss is the mean over all pairs.  What a row's pairs add to it depends on
its own strength alone, given the strengths of the other label, and smoothly so.  One
pass over the rows sums it at Chebyshev nodes, from which a second one has it at each
row's strength, to about 12 digits, and sums up the loss and its gradient.  Such rounds
(BFGS) go on until a step has nothing to gain.  They begin at the fit and the curvature of
about ``per_label`` rows a label, which says where the search starts and so how many
rounds it takes, not where it ends.  Rows that repeat an id and its text count as one.

The strength that is the quantile of the share of label 0 in all labelled rows is the
threshold: strengths are mapped to 0..1 so that it falls on ``cut``, with the slope of
greatest likelihood, both from all labelled rows.  A document is predicted 1 from ``cut`` on.

Null texts are empty; empty texts get the score of their features, as all others do.
Rows with null id or label, or other labels than 0 and 1, are not learned from.  If a
label is missing every score is 0 or 1 as the other label says, and 0.5 without any
labelled row.  Rows that repeat an id are scored each on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.words import BLANKS, LOWER, Tally, parts, raw
from quern.operators.ordering import ordered, running
from quern.session import stash, unstash

#: Hashed pairs of bytes, a power of two; bytes and rows that are counted at once.
PAIRS = 512
PART_BYTES, PART_ROWS = 2_000_000, 400
DIMS = 256 + PAIRS + 4
#: Squared weights are part of the loss by half of this.
PENALTY = 1e-4
#: A search ends when a step promises less than this share of the loss.
LEAST_GAIN = 1e-8
#: Most that the last features reach: shares, words of 100 bytes, 2^64 bytes.
MOST = np.array([1.0, 1.0, 5.0, 2.0])
DIGITS = LOWER.copy()
DIGITS[0x30:0x3A] = 0x30


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of DIMS features per text."""
    n, tally = len(texts), Tally(len(texts))
    single, double = np.zeros((n, 256)), np.zeros((n, PAIRS))
    ended = (-1, 0)
    for first, some in parts(texts, BLANKS, PART_BYTES, PART_ROWS):
        data, at = raw(some)
        if not len(data):
            continue
        m, row = len(some), np.repeat(np.arange(len(some)), np.diff(at))
        single[first : first + m] += np.bincount(row * 256 + data, minlength=m * 256).reshape(m, 256)
        shape = DIGITS[data].astype(np.uint32)
        hashed = lambda a, b: ((a << np.uint32(8) | b) * np.uint32(2654435761)) >> np.uint32(32 - PAIRS.bit_length() + 1)
        inside = row[1:] == row[:-1]
        place = row[1:][inside] * PAIRS + hashed(shape[:-1], shape[1:])[inside]
        double[first : first + m] += np.bincount(place, minlength=m * PAIRS).reshape(m, PAIRS)
        if ended[0] == first:  # the pair that a cut took apart
            double[first, hashed(ended[1], shape[:1])[0]] += 1
        ended = (first, shape[-1:]) if m == 1 else (-1, 0)
        tally.add(first, some, BLANKS)
    size = single.sum(axis=1, keepdims=True)
    share = lambda x: np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))
    words = np.maximum(tally.words, 1)
    more = [tally.distinct / words, tally.repeated / words, np.minimum(size[:, 0] / words / 20, 5), np.log2(1 + size[:, 0]) / 32]
    return np.hstack([share(single), share(double), np.array(more).T]).astype(np.float32)


def fit_strengths(x: np.ndarray, better: np.ndarray, worse: np.ndarray, penalty: float = PENALTY, steps: int = 300) -> np.ndarray:
    """Weights of least mean logistic loss of x[better] - x[worse], by accelerated gradient descent."""
    x = x.astype(np.float64)
    w = v = np.zeros(x.shape[1])
    step = 4.0 / (np.square(x[better] - x[worse]).sum(axis=1).max(initial=1e-9) + 4 * penalty)
    for t in range(steps):
        strength = x @ v
        pull = 1 / (1 + np.exp(np.clip(strength[better] - strength[worse], -500, 500))) / len(better)
        by_row = np.bincount(better, pull, len(x)) - np.bincount(worse, pull, len(x))
        new = v + step * (by_row @ x - penalty * v)
        v = new + t / (t + 3.0) * (new - w)
        w = new
    return w


def quantile_between(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The middle between the last value of the lowest share of all weight and the next."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(weights[order])
    at = min(int(np.searchsorted(upto, share * upto[-1] - 1e-9)), len(values) - 1)
    return float(values[at] + values[min(at + 1, len(values) - 1)]) / 2


def slopes_for(spread: float) -> np.ndarray:
    return np.geomspace(0.05, 50, 200) / max(spread, 1e-9)


def slope_losses(slopes: np.ndarray, strength: np.ndarray, y: np.ndarray, weights: np.ndarray, shift: float) -> np.ndarray:
    """For each slope what its likelihood lacks, summed over the rows."""
    z = np.where(y > 0, 1.0, -1.0) * (slopes[:, None] * strength + shift)
    return (weights * np.logaddexp(0, -z)).sum(axis=1)


def fit_slope(strength: np.ndarray, y: np.ndarray, weights: np.ndarray, shift: float) -> float:
    """The slope of greatest likelihood of sigmoid(slope * strength + shift), within bounds."""
    slopes = slopes_for(strength.std())
    return float(slopes[np.argmin(slope_losses(slopes, strength, y, weights, shift))])


def inverse_curvature(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Inverse Hessian of the mean loss over all pairs of the rows x of label 1 and 0, at w."""
    good, bad = x[y == 1].astype(np.float64), x[y == 0].astype(np.float64)
    s = 1 / (1 + np.exp(-np.clip((good @ w)[:, None] - bad @ w, -500, 500)))
    s = s * (1 - s) / s.size
    mixed = good.T @ (s @ bad)
    own = (good.T * s.sum(axis=1)) @ good + (bad.T * s.sum(axis=0)) @ bad
    return np.linalg.inv(own - mixed - mixed.T + PENALTY * np.eye(len(w)))


def chebyshev(values: np.ndarray) -> np.ndarray:
    """Coefficients of the polynomials through values at cos(pi * (k + 0.5) / n), one a row of values."""
    n = values.shape[1]
    out = 2 / n * values @ np.cos(np.pi * np.outer(np.arange(n) + 0.5, np.arange(n)) / n)
    out[:, 0] /= 2
    return out


def bounds(w: np.ndarray) -> tuple[float, float]:
    """Between these are the strengths of all texts: shares of bytes and of pairs are
    square-rooted, so both are vectors of length 1 at most, without negative parts."""
    reach = lambda u: float(np.linalg.norm(u[:256]) + np.linalg.norm(u[256:-4]) + u[-4:] @ MOST)
    return -reach(np.maximum(-w, 0)) - 1e-6, reach(np.maximum(w, 0)) + 1e-6


def some_rows(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Features, labels and weights of a few rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.float32).reshape(part.num_rows, DIMS).astype(np.float64)
            yield x, part.column("label").to_numpy(), part.column("weight").to_numpy(), part


def summed(rows: DataFrame, size: int, part_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """The sum of the arrays of this size that part_of makes of a task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(part_of(batches), np.zeros(size))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

    found = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    out[[r["at"] for r in found]] = [r.value for r in found]
    return out


def pair_loss(rows: DataFrame, pairs: float, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss at w over all pairs of rows (label, weight, x), and its gradient."""
    low, high = bounds(w)
    n = 64 + int(5 * (high - low))
    middle, half = (low + high) / 2, (high - low) / 2
    nodes = middle + half * np.cos(np.pi * (np.arange(n) + 0.5) / n)

    def at_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for x, y, weight, _ in some_rows(batches):
            lead = np.where(y == 1, -1.0, 1.0)[:, None] * ((x @ w)[:, None] - nodes)
            e = np.exp(-np.abs(lead))
            pull = np.where(lead > 0, 1.0, e) / (1 + e)
            good, bad = weight * (y == 1), weight * (y == 0)
            yield np.concatenate([bad @ (np.maximum(lead, 0) + np.log1p(e)), bad @ pull, good @ pull])

    # loss and pull of a good row at a node by all bad ones, pull of a bad row there by all good ones
    loss, of_good, of_bad = chebyshev(summed(rows, 3 * n, at_nodes).reshape(3, n))

    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for x, y, weight, _ in some_rows(batches):
            at = (x @ w - middle) / half
            value = lambda c: np.polynomial.chebyshev.chebval(at, c)  # noqa: B023, E731
            pull = weight * np.where(y == 1, -value(of_good), value(of_bad))
            yield np.append(pull @ x, (weight * (y == 1)) @ value(loss))

    found = summed(rows, DIMS + 1, gradient) / pairs
    return float(found[-1] + PENALTY / 2 * w @ w), found[:-1] + PENALTY * w


def least_loss(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Where a convex loss is least, from w and about the inverse of its curvature there (BFGS)."""
    f, g = loss(w)
    while True:
        step = -inverse @ g
        gain = -g @ step
        if gain <= LEAST_GAIN * f:
            return w
        part = 1.0
        while True:
            found, then = loss(w + part * step)
            if found <= f - 1e-4 * part * gain:
                break
            part /= 2
            if part < 1e-6:  # rounding is all that is left
                return w
        moved, turned = part * step, then - g
        w, f, g = w + moved, found, then
        along = inverse @ turned
        r = 1 / max(moved @ turned, 1e-300)
        inverse = inverse + (1 + r * (turned @ along)) * r * np.outer(moved, moved) - r * (np.outer(moved, along) + np.outer(along, moved))


@dataclass
class QualityModel:
    w: np.ndarray | None
    threshold: float
    slope: float
    cut: float
    constant: float = 0.5

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.w is None:
            return np.full(len(texts), self.constant)
        z = self.slope * (text_features(texts) @ self.w - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def learn_quality(docs: DataFrame, labels: DataFrame, training: Column, cut: float = 0.3, per_label: int = 2000, rounds: int = 8, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from all rows of docs where training holds (a column over doc_id) and that labels (id, label) cover.

    per_label: distinct rows per label, in expectation, with which the search for the
    weights starts.  rounds: pairs there that each of them is in on its own account.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.filter(training).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter(training).withColumn("key", F.xxhash64("doc_id", "text"))
    # ids and keys only; rows that repeat both share a weight of 1
    covered = rows.groupBy("doc_id", "key").agg((1 / F.count("*")).alias("weight")).join(known, "doc_id").select("key", "label", "weight")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(k, PART_ROWS)
                x = text_features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "x"])

    # features are shorter than texts, so they are what meets the labels
    learned = stash(rows.select("key", "text").mapInArrow(featured, "key long, x binary").join(covered, "key"), "quality")
    counts = {r.label: r.n for r in learned.groupBy("label").agg(F.countDistinct("key").alias("n")).collect()}
    if len(counts) < 2:
        unstash(learned)
        return QualityModel(None, 0.0, 0.0, cut, float(next(iter(counts), 0.5)))

    def started(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        x, y = np.frombuffer(b"".join(pdf.x), np.float32).reshape(len(pdf), DIMS), pdf.label.to_numpy()
        sides = [np.flatnonzero(y == 1), np.flatnonzero(y == 0)]
        draw, pairs = np.random.default_rng(0), []
        for own, other, swap in ((*sides, False), (*sides[::-1], True)):
            for _ in range(rounds if len(own) and len(other) else 0):
                met = other[draw.permutation(max(len(own), len(other)))[: len(own)] % len(other)]
                pairs.append((met, own) if swap else (own, met))
        if not pairs:
            return pd.DataFrame({"w": [], "inverse": []})
        better, worse = (np.concatenate(side) for side in zip(*pairs, strict=True))
        w = fit_strengths(x, better, worse, PENALTY)
        return pd.DataFrame({"w": [w], "inverse": [inverse_curvature(x, y, w).tobytes()]})

    point = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0
    share = F.when(F.col("label") == 0, per_label / counts[0]).otherwise(per_label / counts[1])
    first = learned.filter(point < share).dropDuplicates(["key"]).withColumn("model", F.lit(0))
    first = first.groupBy("model").applyInPandas(started, "w array<double>, inverse binary").collect()
    w, inverse = (np.array(first[0].w), np.frombuffer(first[0].inverse).reshape(DIMS, DIMS)) if first else (np.zeros(DIMS), np.eye(DIMS))
    w = least_loss(lambda v: pair_loss(learned, float(counts[0]) * counts[1], v), w, inverse)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, _, part in some_rows(batches):
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array(x @ w)], ["key", "label", "strength"])

    found = learned.mapInArrow(strengths, "key long, label int, strength double").groupBy("key").agg(F.max("label").alias("label"), F.max("strength").alias("strength"), F.lit(1).cast("long").alias("one"))
    placed = ordered(found, [], ["strength", "key"])
    spread = placed.agg(F.stddev_pop("strength")).first()[0]
    around = running(placed, [], before=("sum", "one")).filter(F.col("before").isin(counts[0] - 1, counts[0])).select("strength").collect()
    threshold = quantile_between(np.array([r.strength for r in around]), np.ones(2), 0.5)
    slopes, shift = slopes_for(spread), float(np.log(cut / (1 - cut)))

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield slope_losses(slopes, part.column("strength").to_numpy() - threshold, part.column("label").to_numpy(), np.ones(part.num_rows), shift)

    slope = slopes[np.argmin(summed(placed.select("label", "strength"), len(slopes), losses))]
    unstash(learned, placed)
    return QualityModel(w, threshold, float(slope), cut)


def quality_scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            score = np.concatenate([model.score(batch.column("text").slice(k, PART_ROWS)) for k in range(0, batch.num_rows, PART_ROWS)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= model.cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int")
