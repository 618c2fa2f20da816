"""Toxicity by compression distance to two zstandard dictionaries, an ordinary and a toxic one.

Both begin with a dictionary trained on ordinary windows. The toxic one ends in
a dictionary trained on toxic texts, reduced to their marking segments; the
ordinary one ends in as many zero bytes, which match nothing, so ordinary words
compress alike under both and only toxic wording makes a difference. (A toxic
dictionary trained on unreduced windows is filled with ordinary words and hardly
separates; README has figures.) A window's evidence is how many bytes shorter it
gets with the toxic dictionary. Documents are judged by their windows' evidence
over whole texts, calibrated by logistic regression on labelled rows that trained
no dictionary.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_rows, texts
from ._text import give_back, mix, ngrams

#: The bound of training: so many labelled rows of each label, the first ones by a hash of their id, with their whole texts.
SAMPLE_ROWS = 1500
WINDOW = 200
LEVEL = 13
ORDINARY_BYTES = 16_000
TOXIC_BYTES = 2_000
#: Of these, what goes to frequent wording that training leaves out.
MISSED_BYTES = 500
SEGMENT_BYTES = range(5, 9)
#: A marking segment's log-odds exceed LEAST_ODDS; times its toxic training texts, they reach LEAST_EVIDENCE.
LEAST_ODDS = 2.3
LEAST_EVIDENCE = 18.4
PREDICT = 0.3
#: Rows whose crc32(doc_id as text) mod 4 is this are held out of all training.
HELD_OUT = 2
FEATURES = 6

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """Lower-case words joined by one space, with a space at both ends."""
    return b" " + b" ".join((text or "").encode().translate(_PLAIN).split()) + b" "


def windows(own: bytes, size: int = WINDOW) -> list[bytes]:
    return [own[i : i + size] for i in range(0, len(own), size)]


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(256))
_BUCKETS = 22


def _grams(text: bytes):
    """(n, hash of each segment of n bytes, whether it lies within a word and the spaces beside it) of a plain text."""
    data = np.frombuffer(text, np.uint8)
    spaces = np.concatenate([[0], np.cumsum(data == 32)])
    spread, at = _BYTE[data], np.array([0, len(data)])
    for n in SEGMENT_BYTES:
        if len(data) >= n:
            yield n, ngrams(spread, at, n)[0], spaces[n - 1 :][: len(data) - n + 1] == spaces[1:][: len(data) - n + 1]


def _segments(text: bytes) -> np.ndarray:
    """The distinct hashes of a plain text's segments."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(own[within] for _, own, within in _grams(text))]))


def _places(known: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of `own` would be in sorted `known`, and whether it is there."""
    if not len(known):
        return np.zeros(len(own), np.int64), np.zeros(len(own), bool)
    where = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return where, known[where] == own


def marking_segments(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """The sorted hashes of word segments whose document frequency is much higher in toxic texts than in ordinary ones."""
    most = math.log(2 * (len(ordinary) + 1))  # the log-odds of a segment of all toxic and no ordinary texts
    # Buckets bound the frequencies from above, so that only what may be frequent enough is counted one by one.
    bound = np.zeros(1 << _BUCKETS, np.int32)
    for text in toxic:
        bound[np.unique(_segments(text) >> np.uint64(64 - _BUCKETS))] += 1
    often = bound * most >= LEAST_EVIDENCE
    kept = [own[often[own >> np.uint64(64 - _BUCKETS)]] for own in map(_segments, toxic)]
    found, count = np.unique(np.concatenate(kept), return_counts=True)
    found, count = found[count * most >= LEAST_EVIDENCE], count[count * most >= LEAST_EVIDENCE]
    other = np.zeros(len(found), np.int64)
    for text in ordinary:
        where, hit = _places(found, _segments(text))
        other[where[hit]] += 1
    odds = np.log((count + 0.5) / (len(toxic) + 1)) - np.log((other + 0.5) / (len(ordinary) + 1))
    return found[(odds > LEAST_ODDS) & (count * odds >= LEAST_EVIDENCE)]


def reduced(text: bytes, marks: np.ndarray) -> bytes:
    """The parts of a text's words that marking segments cover, joined by one space."""
    depth = np.zeros(len(text) + 1, np.int64)
    for n, own, within in _grams(text):
        where = np.flatnonzero(within & _places(marks, own)[1])
        np.add.at(depth, where, 1)
        np.add.at(depth, where + n, -1)
    left = np.where(np.cumsum(depth[:-1]) > 0, np.frombuffer(text, np.uint8), np.uint8(32))
    return b" " + b" ".join(left.tobytes().split()) + b" "


def dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary, `size` bytes at most; of too few samples to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size * 4 // 3 + 300, samples, level=9).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def missed(wording: list[bytes], trained: bytes) -> bytes:
    """The most frequent pieces of wording that training left out of its dictionary, MISSED_BYTES at most."""
    count = Counter(w for t in wording for w in set(t.split()) if w not in trained)
    out, size = [], 0
    for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0])):
        if size + len(w) + 1 > MISSED_BYTES:
            break
        out.append(w)
        size += len(w) + 1
    return b" ".join(reversed(out)) + b" "


class Model:
    """The dictionaries and the calibration; compressors are made where they are used."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = toxic, ordinary
        self.mean, self.scale, self.weights = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1)
        self._own = None

    def __getstate__(self):
        return self.__dict__ | {"_own": None}

    def compressors(self):
        if self._own is None:
            self._own = []
            for raw in (self.toxic, self.ordinary):
                how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
                own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(compression_params=how)
                self._own.append(zstandard.ZstdCompressor(compression_params=how, dict_data=own))
        return self._own

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: the windows' mean evidence, its maximum, sum over root of the count, shares of windows with 2 and with 3 bytes, log of the count."""
        toxic, ordinary = (c.compress for c in self.compressors())
        counts, gains = [], []
        for text in texts:
            own = windows(plain(text))
            counts.append(len(own))
            gains += [len(ordinary(w)) - len(toxic(w)) for w in own]
        count, gain = np.array(counts), np.array(gains, np.float64)
        at = np.cumsum(count) - count
        total = np.add.reduceat(gain, at)
        return np.stack([total / count, np.maximum.reduceat(gain, at), total / np.sqrt(count), np.add.reduceat(gain >= 2, at) / count, np.add.reduceat(gain >= 3, at) / count, np.log(count)], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        """Logistic regression, with the intercept moved from the sample's share of toxic rows to the labels' own."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)
        w = np.zeros(z.shape[1])
        ridge = np.diag([1.0] * (len(w) - 1) + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        now = y.mean()
        w[-1] += math.log(share / (1 - share)) - math.log(now / (1 - now))
        self.weights = w


def fit(rows: list[tuple[int, str, int]], share: float) -> Model:
    """Train on (fold, text, label): fold 0 trains the dictionaries and others calibrate. `share`: of toxic ones among all labels.

    Without both labels in both parts there is nothing to compare: every score is `share`.
    """
    train, rest = [r for r in rows if r[0] == 0], [r for r in rows if r[0] != 0]
    if len({r[2] for r in train}) < 2 or len({r[2] for r in rest}) < 2:
        model = Model(b"\0" * 16, b"\0" * 16)
        model.weights[-1] = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return model
    toxic, ordinary = ([plain(t) for _, t, y in train if y == k] for k in (1, 0))
    base = dictionary([w for t in ordinary for w in windows(t)], ORDINARY_BYTES)
    marks = marking_segments(toxic, ordinary)
    wording = [own for own in (reduced(t, marks) for t in toxic) if own.strip()]
    tail = dictionary(wording, TOXIC_BYTES - MISSED_BYTES)
    tail = missed(wording, tail) + tail
    model = Model(base + tail, base + b"\0" * len(tail))
    y = np.array([r[2] for r in rest])
    model.calibrate(model.features([r[1] for r in rest]), y, share)
    return model


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled documents that are not held out; of a repeated doc_id the smallest text."""
    usable = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).where(fold(F.col("doc_id")) != HELD_OUT)
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    few = [usable.where(F.col("label") == k).select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE_ROWS) for k in (0, 1)]
    found = texts(docs).where("text is not null").join(F.broadcast(few[0].union(few[1])), "doc_id")
    once = found.groupBy("h", "doc_id", "label").agg(F.min("text").alias("text"))
    rows = once.select("h", "doc_id", "text", "label", F.when(fold(F.col("doc_id")) == 3, 1).otherwise(0).alias("fold")).collect()
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    return fit([(r.fold, r.text, r.label) for r in sorted(rows, key=lambda r: (r.h, r.doc_id))], share)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = PREDICT) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of (doc_id, text).

    The score depends on the text alone; null text is empty and scored like any
    other, a very long one window by window, whole. Rows of null doc_id are
    scored and never held out. Equal texts tie. Repeated rows give the same score
    each; other columns, whatever their names, are left out; an empty table gives
    no rows; without labels of both kinds every score is their share of toxic ones.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        own = shared.value
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                score = own.probability(own.features(part.column("text").to_pylist()))
                yield pa.record_batch([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])
        give_back()

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
