"""Stretches of words that repeat with a period, by string synchronising sets at dyadic scales.

At scale t, a window of t words has a hash of its contents. A position is
selected if, of the windows that start in the t + 1 places from it on, the least
hash stands first or last; windows of period t / 4 or less take no part. Equal
contexts of 2 t words are therefore selected alike, and every stretch of 3 t - 1
words has a selected position among its first t unless it is highly periodic.

In a run of period q, t <= q < 2 t, of four periods or more, a selected position
and the one q words on have equal contexts, and no equal one is between them. So
each pair of neighbouring selected positions of equal contexts proposes its
distance as a period; proposals are extended word by word. The highly periodic
windows left out at scale t lie in runs of periods up to t / 4, which smaller
scales have found before; these runs are both the omitted small periods and the
marks of what to leave out. Contexts have exact names, pairs of names of half
their length, so nothing rests on hashes but the selection.

Documents are independent; an Arrow batch is searched at once, the longest
documents first, so that larger scales see only documents long enough for them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import arrow_rows, texts
from ._text import mix, ranges, slices, spaced, text_array, utf8, words

#: A run has so many periods at least.
PERIODS = 4
#: And so many words.
LEAST = 6
#: Comparisons made at once while runs are extended.
AT_ONCE = 1 << 20

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _selected(names: np.ndarray, scale: int, left_out: np.ndarray) -> np.ndarray:
    """The synchronising set: positions whose window or the one `scale` on has the least hash between them; windows left out have none."""
    low = mix(names.astype(np.uint64) + np.uint64(1))
    low[left_out] = _NONE
    least, k = low, 1
    while k < scale:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    least = np.minimum(least[:-1], least[1:])
    n = len(least)
    return np.flatnonzero(((least == low[:n]) | (least == low[scale : scale + n])) & (least != _NONE))


def _periodic(runs: list[tuple], scale: int, n: int) -> np.ndarray:
    """Which of n windows of `scale` words have a period of at most a quarter of it: those inside such a run."""
    change = np.zeros(n + 1, np.int64)
    for start, end, period in runs:
        own = (period * PERIODS <= scale) & (end - start >= scale) & (start < n)
        np.add.at(change, start[own], 1)
        np.add.at(change, np.minimum(end[own] - scale + 1, n), -1)
    return np.cumsum(change[:-1]) > 0


def _mismatch(x: np.ndarray, at: np.ndarray, period: np.ndarray, step: int, width: int) -> np.ndarray:
    """The first place from `at` on, forwards or backwards, whose word differs from the one a period on."""
    at, found = at.copy(), np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    place = np.arange(width) * step
    while len(open_):
        later = []
        for i in range(0, len(open_), max(1, AT_ONCE // width)):
            own = open_[i : i + max(1, AT_ONCE // width)]
            here = np.clip(at[own, None] + place, 0, len(x) - 1)
            differs = x[here] != x[np.minimum(here + period[own, None], len(x) - 1)]
            first = differs.argmax(axis=1)
            hit = differs[np.arange(len(own)), first]
            found[own[hit]] = at[own[hit]] + step * first[hit]
            at[own] += step * width
            later.append(own[~hit])
        open_ = np.concatenate(later)
    return found


def find_runs(x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run of PERIODS periods or more.

    `x` has whole numbers for words: a separator, then each document, the
    longest first, and a separator after it; no separator's number occurs twice.
    """
    ends = np.cumsum(lengths + 1) + 1
    runs, scale, names = [], 1, pd.factorize(x)[0].astype(np.int64)
    while True:
        long_enough = int(np.searchsorted(-lengths, -PERIODS * scale, side="right"))
        n = int(ends[long_enough - 1]) if long_enough else 0
        if n < 2 * scale + 1:
            break
        names = names[: n - scale + 1]
        pairs = names[:-scale] * (int(names.max()) + 1) + names[scale:]
        contexts = pd.factorize(pairs)[0].astype(np.int64)
        at = _selected(names, scale, _periodic(runs, scale, len(names)))
        own = contexts[at]
        order = np.argsort(own, kind="stable")
        at, own = at[order], own[order]
        period = np.diff(at)
        near = (own[1:] == own[:-1]) & (period >= scale) & (period < 2 * scale)
        at, period = at[:-1][near], period[near]
        if len(at):
            order = np.lexsort((at, period))
            at, period = at[order], period[order]
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(period) != 0) | (np.diff(at) > 2 * scale)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            period = period[first]
            width = max(16, scale)
            end = _mismatch(x, at[last] + 2 * scale, period, 1, width) + period
            start = _mismatch(x, at[first] - 1, period, -1, width) + 1
            keep = end - start >= PERIODS * period
            found = np.unique(np.stack([start[keep], end[keep], period[keep]]), axis=1)
            runs.append(tuple(found))
        names, scale = contexts, 2 * scale
    if not runs:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*runs))


def _document_runs(ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start, end and period of the runs of rows of words, in order of row, start and period."""
    count = np.diff(before)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    lengths = count[order]
    x = np.full(int(lengths.sum()) + len(lengths) + 1, -1, np.int64)
    at = np.cumsum(lengths + 1) - lengths
    x[ranges(at, lengths)] = ids[ranges(before[order], lengths)]
    gaps = np.flatnonzero(x < 0)
    x[gaps] = (ids.max() if len(ids) else 0) + 1 + np.arange(len(gaps))
    start, end, period = find_runs(x, lengths)
    keep = end - start >= LEAST
    start, end, period = start[keep], end[keep], period[keep]
    which = np.searchsorted(at, start, side="right") - 1
    row, start, end = order[which], start - at[which], end - at[which]
    order = np.lexsort((period, start, row))
    return row[order], start[order], end[order], period[order]


def _search(batches):
    for batch in slices(batches):
        data, at = utf8(batch.column("text"))
        start, end, before = words(data, at)
        ids = text_array(data, start, end).dictionary_encode().indices.to_numpy().astype(np.int64)
        row, first, last, period = _document_runs(ids, before)
        # A run's words after its first period go.
        change = np.zeros(len(start) + 1, np.int64)
        np.add.at(change, before[row] + first + period, 1)
        np.add.at(change, before[row] + last, -1)
        kept = np.cumsum(change[:-1]) == 0
        raw, begin, stop = spaced(data, start[kept], end[kept])
        cut = np.concatenate([[0], np.cumsum(kept)])[before]
        texts_ = [raw[begin[a] : stop[b - 1]].decode() if b > a else "" for a, b in zip(cut[:-1], cut[1:])]
        offsets = np.searchsorted(row, np.arange(len(before))).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(first), pa.array(last - first), pa.array(period)], ["start", "length", "period"])
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(np.diff(before), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(texts_, pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period) and the collapsed text of every row.

    A run is a longest stretch of words with smallest period q, of PERIODS * q
    and LEAST words at least. The collapsed text has the words, joined by one
    space, but for those that any run has after its first q words. Null, empty
    and blank texts have no runs and collapse to nothing; a very long text is
    searched whole. Runs that share words count each. Repeated rows and rows of
    null doc_id give their result each; other columns, whatever their names,
    are left out. An empty table gives no rows.
    """
    arrow_rows(docs.sparkSession)
    return texts(docs).mapInArrow(_search, SCHEMA)
