"""Repeated passages by relative Lempel-Ziv parsing against every earlier document.

The corpus is cut into reference blocks. A block's phrases, all its windows of
WINDOW consecutive words, are indexed by hash: index tasks hold a range of hashes
each and know a phrase's first place (document, word) over all blocks. A document
is then parsed greedily: a factor starts at a window that has an earlier first
place and grows while the next window's first place is the next word of the same
reference. Where a factor ends, each window across the boundary has been looked
up by itself, so a copy put together from several references loses no word.

Blocks and look-ups travel packed, a binary cell for each block and hash range.
A phrase leaves its block once, whatever its copies there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_rows, small_side, texts, written
from ._text import ngrams, slices, utf8, word_hashes, words

WINDOW = 13
#: Text bytes of a reference block; one longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Characters of input for each index task; 64 tasks at least.
RANGE_CHARS = 6_000_000

CELL = "part int, hashes binary, docs binary, places binary, firsts binary"
FACTORS = "doc_id long, start int, length int, ref_doc long, ref_start int"


def _planes(x: np.ndarray) -> bytes:
    """The byte planes of integers, so that compression finds the empty ones."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind)[:, 0] if raw else np.zeros(0, kind)


def _blocks(batches):
    """Batches joined to blocks, rows in order of doc_id; doc_id repeats come last and are not indexed twice."""
    held, size = [], 0
    for batch in slices(batches, limit=BLOCK_BYTES):
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()


def _index(batches, parts: int, window: int):
    """The cells of each block: its phrases' hashes with their first places in the block, and what the block itself repeats."""
    for table in _blocks(batches):
        ids = table.column("doc_id").to_numpy()
        grams, places, docs = [], [], []
        for batch in slices(iter(table.to_batches())):
            data, at = utf8(batch.column("text"))
            start, end, before = words(data, at)
            own, cut = ngrams(word_hashes(data, start, end), before, window)
            count = np.diff(cut)
            grams.append(own)
            places.append(np.arange(cut[-1]) - np.repeat(cut[:-1], count))
            docs.append(np.repeat(batch.column("doc_id").to_numpy(), count))
        g, p, d = np.concatenate(grams), np.concatenate(places).astype(np.uint32), np.concatenate(docs)
        if not len(g):
            continue
        order = np.argsort(g, kind="stable")
        new = np.empty(len(g), bool)
        new[0] = True
        np.not_equal(g[order][1:], g[order][:-1], out=new[1:])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]
        lead = np.empty(len(g), np.int64)
        lead[order] = first
        known = d[lead] < d
        part = (g % np.uint64(parts)).astype(np.int32)
        for mask, with_first in ((~known, False), (known, True)):
            where = np.flatnonzero(mask)
            where = where[np.argsort(part[where], kind="stable")]
            cuts = np.flatnonzero(np.diff(part[where], prepend=-1, append=-1)) if len(where) else np.zeros(1, int)
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = where[a:b]
                own_first = lead[own]
                rows.append((int(part[own[0]]), b"" if with_first else _planes(g[own]), _planes(d[own]), _planes(p[own]), _planes(np.concatenate([d[own_first], p[own_first].astype(np.int64)])) if with_first else b""))
            if rows:
                c = list(zip(*rows))
                yield pa.record_batch([pa.array(c[0], pa.int32()), *(pa.array(x, pa.binary()) for x in c[1:])], ["part", "hashes", "docs", "places", "firsts"])


def _look_up(parts: int):
    def run(table: pa.Table) -> pa.Table:
        """For one range of hashes: the windows that start in an earlier document, with their first places, dealt by document."""
        g, d, p, out = [], [], [], []
        for h, a, b, f in zip(*(table.column(c).to_pylist() for c in ("hashes", "docs", "places", "firsts"))):
            docs, places = _unplanes(a, np.int64), _unplanes(b, np.uint32)
            if h:
                g.append(_unplanes(h, np.uint64))
                d.append(docs)
                p.append(places)
            else:
                first = _unplanes(f, np.int64)
                out.append((docs, places, first[: len(docs)], first[len(docs) :].astype(np.uint32)))
        if g:
            g, d, p = np.concatenate(g), np.concatenate(d), np.concatenate(p)
            order = np.lexsort((p, d, g))
            g, d, p = g[order], d[order], p[order]
            new = np.empty(len(g), bool)
            new[0] = True
            np.not_equal(g[1:], g[:-1], out=new[1:])
            first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            late = d[first] < d
            out.append((d[late], p[late], d[first][late], p[first][late]))
        rows = []
        if out:
            d, p, rd, rp = (np.concatenate(x) for x in zip(*out))
            home = (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
            order = np.lexsort((p, d, home))
            home, d, p, rd, rp = home[order], d[order], p[order], rd[order], rp[order]
            cuts = np.flatnonzero(np.diff(home.astype(np.int64), prepend=-1, append=-1)) if len(d) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows.append((int(home[a]), b"", _planes(d[a:b]), _planes(p[a:b]), _planes(np.concatenate([rd[a:b], rp[a:b].astype(np.int64) - p[a:b]]))))
        c = list(zip(*rows)) or [()] * 5
        return pa.table([pa.array(c[0], pa.int32()), *(pa.array(x, pa.binary()) for x in c[1:])], ["part", "hashes", "docs", "places", "firsts"])

    return run


def _parse(window: int):
    def run(table: pa.Table) -> pa.Table:
        """The factors of all documents of one deal: runs of windows whose first places follow on in one reference."""
        got = []
        for a, b, f in zip(*(table.column(c).to_pylist() for c in ("docs", "places", "firsts"))):
            docs, first = _unplanes(a, np.int64), _unplanes(f, np.int64)
            got.append((docs, _unplanes(b, np.uint32).astype(np.int64), first[: len(docs)], first[len(docs) :]))
        d, p, rd, shift = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((p, d))
        d, p, rd, shift = d[order], p[order], rd[order], shift[order]
        # A repeated row has looked up the same windows again.
        once = np.ones(len(d), bool)
        once[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1])
        d, p, rd, shift = d[once], p[once], rd[once], shift[once]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1) | (rd[1:] != rd[:-1]) | (shift[1:] != shift[:-1])
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(d))) + window - 1
        return pa.table(
            [pa.array(d[at]), pa.array(p[at].astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(rd[at]), pa.array((p[at] + shift[at]).astype(np.int32))],
            ["doc_id", "start", "length", "ref_doc", "ref_start"],
        )

    return run


def factors(docs: DataFrame, window: int = WINDOW, range_chars: int = RANGE_CHARS) -> DataFrame:
    """The long factors of every document: doc_id, start, length (words), ref_doc, ref_start.

    Null text has no words. Rows that share a doc_id are one document, which
    never repeats itself. Rows of null doc_id have no factors and are no
    reference. An empty table gives no rows.
    """
    arrow_rows(docs.sparkSession)
    rows = texts(docs).where("doc_id is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(max(64, chars // range_chars))
    cells = rows.mapInArrow(lambda batches: _index(batches, parts, window), CELL)
    answers = cells.groupBy("part").applyInArrow(_look_up(parts), CELL)
    return answers.groupBy("part").applyInArrow(_parse(window), FACTORS)


def _without(batches):
    """Each text's words but those under a span; spans come sorted and apart."""
    for batch in slices(batches):
        data, at = utf8(batch.column("text"))
        start, end, before = words(data, at)
        count, gone, digest, text = np.diff(before), [], [], []
        raw = data.tobytes()
        for k, spans in enumerate(batch.column("spans").to_pylist()):
            a, b = int(before[k]), int(before[k + 1])
            keep, last, removed = [], a, 0
            for s in spans or ():
                keep.append((last, a + s["from"]))
                last = a + s["to"]
                removed += s["to"] - s["from"]
            keep.append((last, b))
            left = b" ".join(b" ".join(raw[start[i] : end[j - 1]].split()) for i, j in keep if j > i)
            gone.append(removed)
            digest.append(hashlib.sha256(left).hexdigest())
            text.append(left.decode())
        yield pa.record_batch([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def spans(found: DataFrame) -> DataFrame:
    """The words of each document that some factor covers, as sorted separate spans [from, to)."""
    each = F.array_sort(F.collect_list(F.struct(F.col("start").alias("from"), (F.col("start") + F.col("length")).alias("to"))))
    joined = F.expr(
        "aggregate(s, cast(array() as array<struct<from:int,to:int>>), (acc, x) -> "
        "case when size(acc) > 0 and element_at(acc, -1).to >= x.from then "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('from', element_at(acc, -1).from, 'to', greatest(element_at(acc, -1).to, x.to)))) "
        "else concat(acc, array(x)) end)"
    )
    return found.groupBy("doc_id").agg(each.alias("s")).select("doc_id", joined.alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row.

    A word goes if a window over it also starts in a document of smaller doc_id.
    Null text has no words; a very long one is judged whole; repeated rows give
    the same result each; rows of null doc_id lose nothing and take nothing from
    others; of equal windows the smallest doc_id and then the first place counts.
    Other columns, whatever their names, are left out. An empty table gives no
    rows.
    """
    own = written(spans(factors(docs, window)), "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return texts(docs).join(small_side(own), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_without, schema)
