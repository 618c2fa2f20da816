"""Quality rules and a hashed word and character n-gram classifier, probability-calibrated."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_rows, texts
from ._text import IS_SPACE, LOWER, mix, ngrams, slices, utf8, word_hashes, words

BITS = 18
#: The bound of training: so many labelled rows, the first ones by a hash of their id, with their whole texts.
SAMPLE_ROWS = 3000
#: Features of sample rows that one step of training holds beside the sample.
STEP_FEATURES = 1 << 20
#: One in so many sample rows calibrates instead of training.
CALIBRATE_EACH = 4
#: Documents under this probability of good quality are not kept.
THRESHOLD = 0.5
MIN_WORDS = 50
REPEAT_PERCENT = 50

SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
CHAR_GRAMS = (3, 5)

SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids of all rows and how many come before each row: words, word pairs and character n-grams."""
    data, at = utf8(column)
    data = LOWER[data]
    start, end, before = words(data, at)
    hashes = word_hashes(data, start, end)
    groups = [ngrams(hashes, before, n) for n in (1, 2)]
    spread = _CHAR[data]
    for n in CHAR_GRAMS:
        groups.append(ngrams(spread, at, n))
    counts = np.stack([np.diff(cut) for _, cut in groups])
    total = np.concatenate([[0], np.cumsum(counts.sum(axis=0))])
    out = np.empty(total[-1], np.int64)
    place = total[:-1].copy()
    for (own, cut), count in zip(groups, counts):
        out[np.repeat(place - cut[:-1], count) + np.arange(cut[-1])] = (own >> np.uint64(64 - BITS)).astype(np.int64)
        place += count
    return out, total


_CHAR = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))


def _means(weights: np.ndarray, ids: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The mean weight of each row's features; 0 for a row without any."""
    count = np.diff(cut)
    sums = np.zeros(len(count))
    full = count > 0
    if full.any():
        sums[full] = np.add.reduceat(weights[ids], cut[:-1][full])
    return sums / np.maximum(count, 1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(1 | score), with smoothed targets."""
    scale = score.std() or 1.0
    z = np.stack([score / scale, np.ones(len(score))], axis=1)
    ones = y.sum()
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, z.T @ (p - t) + 1e-3 * w)
    return float(w[0] / scale), float(w[1])


class Model:
    """Logistic regression over mean hashed features, with a Platt slope and intercept."""

    def __init__(self, weights: np.ndarray, slope: float, intercept: float):
        self.weights, self.slope, self.intercept = weights, slope, intercept

    def probability(self, ids: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * _means(self.weights, ids, cut) + self.intercept)


def fit(rows: list[tuple[str, int]], epochs: int = 60, rate: float = 200.0) -> Model:
    """Train on labelled texts in the given order. Without both labels, everything has the one label's share."""
    y = np.array([label for _, label in rows], np.float64)
    if len(set(y)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 40.0 if not len(y) or y[0] == 1 else -40.0)
    held = np.arange(len(rows)) % CALIBRATE_EACH == 0
    held &= np.array([len(set(y[~held])) == 2]).all()
    goal = y[~held]
    balance = np.where(goal == 1, len(goal) / (2 * max(goal.sum(), 1)), len(goal) / (2 * max(len(goal) - goal.sum(), 1)))
    steps = list(_steps(text for (text, _), h in zip(rows, held) if not h))
    weights, bias, seen = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8)
    for _ in range(epochs):
        slope, drift, at = np.zeros(1 << BITS), 0.0, 0
        for ids, share, count in steps:
            own = slice(at, at + len(count))
            error = (sigmoid(_scores(weights, ids, share, count) + bias) - goal[own]) * balance[own] / len(goal)
            slope += np.bincount(ids, share * np.repeat(error, count), 1 << BITS)
            drift += error.sum()
            at += len(count)
        seen += slope * slope
        weights -= slope / np.sqrt(seen) * (rate / 100)
        bias -= drift
    score = np.zeros(len(rows))
    score[~held] = np.concatenate([_scores(weights, *step) for step in steps])
    if held.any():
        score[held] = np.concatenate([_scores(weights, *step) for step in _steps(text for (text, _), h in zip(rows, held) if h)])
    use = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    return Model(weights.astype(np.float32), *platt(score[use], y[use]))


def _steps(texts):
    """Consecutive texts with about STEP_FEATURES features: their distinct feature ids, shares of all of a text's features, counts of ids."""
    ids, share, count = [], [], []
    for text in texts:
        own, times = np.unique(features(pa.array([text], pa.string()))[0], return_counts=True)
        ids.append(own.astype(np.int32))
        share.append((times / max(times.sum(), 1)).astype(np.float32))
        count.append(len(own))
        if sum(count) >= STEP_FEATURES:
            yield np.concatenate(ids), np.concatenate(share), np.array(count)
            ids, share, count = [], [], []
    if count:
        yield np.concatenate(ids), np.concatenate(share), np.array(count)


def _scores(weights: np.ndarray, ids: np.ndarray, share: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(count)), count), share * weights[ids], len(count))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts: the first `rows` by a hash of the id.

    A broadcast of the chosen ids, so bounded, picks their texts, one for each
    id before any is collected. A null label or text is no example; the smallest
    of several labels or texts for one id counts.
    """
    usable = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = usable.select("doc_id", "label", F.xxhash64(F.col("doc_id"), F.lit(label)).alias("h")).orderBy("h", "doc_id").limit(rows)
    found = texts(docs).where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("h", "doc_id", "label").agg(F.min("text").alias("text"))
    return [(r.text, r.label) for r in sorted(found.collect(), key=lambda r: (r.h, r.doc_id))]


def _repeats(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where the same value occurs before in the same row, and where it occurs again."""
    order = np.lexsort((value, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
    out = np.zeros((2, len(doc)), bool)
    out[0, order[1:]] = same
    out[1, order[:-1]] = same
    return out


def rules(column: pa.Array) -> np.ndarray:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data, at = utf8(column)
    rows = len(at) - 1
    start, end, before = words(data, at)
    hashes = word_hashes(data, start, end)
    summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at])
    begins = (data & 0xC0) != 0x80
    out = np.zeros((5, rows), np.int64)
    out[0] = np.diff(before)
    out[1] = summed(begins & ~IS_SPACE[data])
    out[2] = summed(SYMBOL[data])

    grams, cut = ngrams(hashes, before, 3)
    count = np.diff(cut)
    again = _repeats(np.repeat(np.arange(rows), count), grams).any(axis=0)
    covered = np.zeros(len(start) + 1, np.int64)
    where = np.repeat(before[:-1] - cut[:-1], count) + np.arange(cut[-1])
    np.add.at(covered, where[again], 1)
    np.add.at(covered, where[again] + 3, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    out[4] = np.diff(inside[before])

    # A line's hash comes from all its bytes, its length and whether it has a word.
    breaks = np.flatnonzero(data == 10)
    row_of = np.searchsorted(at, breaks, side="right") - 1
    edge = np.concatenate([at[:-1], breaks + 1])
    edge_row = np.concatenate([np.arange(rows), row_of])
    order = np.lexsort((edge, edge_row))
    low, line_row = edge[order], edge_row[order]
    high = np.append(low[1:], at[-1])
    last = np.append(line_row[1:] != line_row[:-1], True)
    high = np.where(last, at[line_row + 1], high - 1)
    has_word = np.searchsorted(start, high) > np.searchsorted(start, low)
    low, high, line_row = low[has_word], high[has_word], line_row[has_word]
    if len(low):
        out[3] = np.bincount(line_row[_repeats(line_row, _span_hashes(data, low, high))[0]], minlength=rows)
    return out


def _span_hashes(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of each byte span; spans are apart, in order and not empty."""
    value = _CHAR[data]
    place = np.arange(len(data)) - np.repeat(np.append(0, low), np.diff(np.concatenate([[0], low, [len(data)]])))
    power = np.full(int(place.max()) + 1, np.uint64(0x9E3779B97F4A7C15), np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[place])])
    return mix(total[high] - total[low] + (high - low).astype(np.uint64))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rules' counts, base_failed, probability and kept for every row of (doc_id, text).

    A document is kept if it does not fail the fixed rules (under MIN_WORDS
    words, or over REPEAT_PERCENT of them in repeated windows) and the
    classifier gives it `threshold` or more. Null text has no words and fails;
    very long texts are scored whole, one at a time. Equal texts tie. Repeated
    rows give the same result each; other columns, whatever their names, are left
    out; an empty table gives no rows; without labels only the rules decide.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    model = fit(sample(docs, labels, "quality"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in slices(batches):
            text = batch.column("text")
            found = rules(text)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x) for x in found), pa.array(own.probability(*features(text)).astype(np.float64))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    scored = texts(docs).mapInArrow(run, SCORED).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
