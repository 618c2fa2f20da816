"""Collocations by prefix-free parsing: n-grams are counted in a dictionary of chunks, weighted by how often each occurs.

A text's pieces are parsed at triggers: two neighbouring words whose hash falls
into one of TRIGGER_EACH classes. A chunk runs from one trigger to the next and
takes that trigger's words along, so that chunks overlap by OVERLAP words and
every n-gram of up to OVERLAP + 1 words lies whole in the chunk in which it
starts. An n-gram belongs to that chunk alone: those that start in the overlap
are left to the next chunk. Where a chunk begins and ends depends on its own
words, so equal passages give equal chunks whatever stands around them, and a
passage's thousand copies are counted in one pass over its dictionary entry.

Counts travel packed, a compressed cell for each batch of the dictionary and part
of the phrases; no part gathers more than its share of distinct phrases.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import arrow_rows, small_side, written
from ._text import LOWER, mix, ranges, slices, spaced, text_array, utf8, word_hashes, words

MAX_WORDS = 3
OVERLAP = MAX_WORDS - 1
#: One pair of neighbouring words in so many is a trigger.
TRIGGER_EACH = 16
LEAST_COUNT = 10
TOP = 2000
#: A candidate goes if a longer one around it has so many hundredths of its count.
INSIDE_PERCENT = 50
UNKNOWN = "und"
#: Parts of a language's candidates that are ranked by themselves first.
PARTS = 64
#: Rows of words or pairs that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_PARTS = 200_000
#: Bytes of text for each part of the counts; 64 parts at least.
PART_BYTES = 5 << 20
#: Bytes of chunks whose n-grams are added up before they leave a task.
COUNT_BYTES = 4 << 20

CUT = np.zeros(256, bool)
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = CUT.copy()
BETWEEN[[0x20, 0x09]] = True


def _joined(word: pa.Array, first: np.ndarray, length: np.ndarray) -> pa.Array:
    """The words first, first + 1, ... of each row as one text, with a space between."""
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), word.take(pa.array(ranges(first, length)))), pa.scalar(" ", pa.large_string()))


def _parse(batches):
    """The chunks of each slice of texts: lang, chunk, starts (its first words, whose n-grams are its own) and times."""
    for batch in slices(batches):
        data, at = utf8(batch.column("text"))
        data = LOWER[data]
        start, end, before = words(data, at, BETWEEN)
        n = len(start)
        if not n:
            continue
        row = np.repeat(np.arange(len(before) - 1), np.diff(before))
        cuts = np.cumsum(CUT[data])[start]
        piece = np.ones(n + 1, bool)  # where a piece begins, and the end
        piece[1:n] = (np.diff(cuts) != 0) | (np.diff(row) != 0)
        h = word_hashes(data, start, end)
        pair = np.zeros(n, np.uint64)
        pair[:-1] = mix(h[:-1] * np.uint64(3) + h[1:])
        trigger = (pair % np.uint64(TRIGGER_EACH) == 0) & ~piece[1:]
        first = np.flatnonzero(piece[:n] | trigger)
        upto = np.append(first[1:], n)
        chunk = _joined(text_array(data, start, end), first, upto - first + np.where(piece[upto], 0, OVERLAP))
        own = pa.table({"lang": batch.column("lang").take(pa.array(row[first])), "chunk": chunk, "starts": pa.array(upto - first)})
        held = own.group_by(["lang", "chunk", "starts"]).aggregate([([], "count_all")])
        yield from pa.table({"lang": held["lang"].cast(pa.string()), "chunk": held["chunk"].cast(pa.string()), "starts": held["starts"], "times": held["count_all"]}).combine_chunks().to_batches()


def chunks(docs: DataFrame) -> DataFrame:
    """The dictionary of all texts' chunks: lang, chunk, starts and times, how often the chunk occurs."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_parse, "lang string, chunk string, starts long, times long").groupBy("lang", "chunk", "starts").agg(F.sum("times").alias("times"))


def _cells_of(table: pa.Table, parts: int):
    """The n-grams that start at the chunks' own words, with weighted counts: a packed cell for each part that has any.

    A word is a phrase by itself; besides it, the longest n-gram at a place stands
    for the shorter ones too. It goes to the part of its first two words, where
    these are counted over all that may follow them.
    """
    data, at = utf8(table.column("chunk").combine_chunks())
    start, end, before = words(data, at)
    hashes = word_hashes(data, start, end)
    ids = text_array(data, start, end).dictionary_encode().indices.to_numpy().astype(np.int64)
    langs = table.column("lang").combine_chunks().dictionary_encode()
    names = langs.dictionary.to_pylist()
    salt = np.array([zlib.crc32(x.encode()) for x in names], np.uint64)
    starts, times = table.column("starts").to_numpy(), table.column("times").to_numpy()
    first, row = ranges(before[:-1], starts), np.repeat(np.arange(len(starts)), starts)
    lang = langs.indices.to_numpy().astype(np.int64)
    room = before[row + 1] - first
    key, out = lang[row], []
    for size in range(1, MAX_WORDS + 1):
        there = room >= size
        first, row, room, key = first[there], row[there], room[there], key[there]
        if not len(first):
            break
        # A shorter phrase's number and the next word make the longer one's.
        key = pa.array(key * len(ids) + ids[first + size - 1]).dictionary_encode().indices.to_numpy().astype(np.int64)
        own = np.flatnonzero((room == size) | (size in (1, MAX_WORDS)))
        total = np.zeros(int(key.max()) + 1, np.int64)
        np.add.at(total, key[own], times[row[own]])
        one = np.zeros(len(total), np.int64)
        one[key[own]] = own
        used = np.flatnonzero(total)
        out.append((first[one[used]], np.full(len(used), size), lang[row[one[used]]], total[used]))
    if not out:
        return
    first, size, lang, total = (np.concatenate(c) for c in zip(*out))
    part = mix(hashes[first] * np.uint64(3) + np.where(size > 1, hashes[np.minimum(first + 1, len(hashes) - 1)], np.uint64(0)) + salt[lang]) % np.uint64(parts)
    order = np.lexsort((lang, part))
    first, size, lang, total, part = first[order], size[order], lang[order], total[order], part[order]
    raw, begin, stop = spaced(data, start, end)
    bytes_ = np.frombuffer(raw, np.uint8)
    length = stop[first + size - 1] - begin[first]
    head = np.where(size > 1, stop[np.minimum(first + 1, len(stop) - 1)] - begin[first], 0)
    text = bytes_[ranges(begin[first], length)].tobytes()
    at = np.concatenate([[0], np.cumsum(length)])
    cut = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1, append=-1))
    pack = zstandard.ZstdCompressor(level=3).compress
    columns = [(total, np.int64), (lang, np.uint16), (length, np.uint32), (head, np.uint32)]
    rows = []
    for i, j in zip(cut[:-1], cut[1:]):
        rows.append((int(part[i]), names, int(j - i), pack(b"".join(planes(c[i:j].astype(kind)) for c, kind in columns) + text[at[i] : at[j]])))
    c = list(zip(*rows))
    yield pa.record_batch([pa.array(c[0], pa.int32()), pa.array(c[1], pa.list_(pa.string())), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], ["part", "langs", "n", "cell"])


def planes(x: np.ndarray) -> bytes:
    """The byte planes of numbers, so that compression finds the empty ones."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpacked(cell: bytes, n: int, number: np.ndarray):
    """(size, lang, phrase, count) of a cell's words, pairs and triples; a triple's first two words are a pair as well. `number` renames the cell's langs."""
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8), 0, []
    for kind in (np.int64, np.uint16, np.uint32, np.uint32):
        width = np.dtype(kind).itemsize
        out.append(raw[at : at + n * width].reshape(width, n).T.copy().view(kind)[:, 0].astype(np.int64))
        at += n * width
    total, lang, length, head = out
    begin, lang = at + np.cumsum(length) - length, number[lang]
    for size, own, upto in ((1, head == 0, length), (2, head > 0, head), (3, (head > 0) & (head < length), length)):
        yield size, pa.array(lang[own]), text_array(raw, begin[own], (begin + upto)[own]), pa.array(total[own])


def _counted(least: int):
    def run(table: pa.Table) -> pa.Table:
        """All counts of one part: its words, its pairs over what follows them, its triples."""
        names, got, out = {}, {1: [], 2: [], 3: []}, []
        for cell, n, langs in zip(table.column("cell"), table.column("n").to_pylist(), table.column("langs").to_pylist()):
            number = np.array([names.setdefault(x, len(names)) for x in langs], np.int32)
            for size, *columns in _unpacked(cell.as_py(), n, number):
                got[size].append(columns)
        for size in (1, 2, 3):
            columns = [pa.chunked_array(c) for c in zip(*got.pop(size))]
            sums = pa.table(dict(zip(("lang", "phrase", "f"), columns))).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
            if size > 1:
                sums = sums.filter(pc.greater_equal(sums["f_sum"], least))
            lang = pa.array(list(names), pa.string()).take(sums["lang"].combine_chunks())
            out.append(pa.table({"lang": lang, "size": pa.array(np.full(len(sums), size, np.int32)), "phrase": sums["phrase"].cast(pa.string()), "f": sums["f_sum"]}))
        return pa.concat_tables(out).combine_chunks()

    return run


def _cells(parts: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= COUNT_BYTES:
                yield from _cells_of(pa.Table.from_batches(held), parts)
                held, size = [], 0
        if held:
            yield from _cells_of(pa.Table.from_batches(held), parts)

    return run


def gram_counts(dictionary: DataFrame, least: int = LEAST_COUNT, parts: int = 64) -> DataFrame:
    """lang, size, phrase and f for all words and for the phrases that occur `least` times or more."""
    cells = dictionary.mapInArrow(_cells(parts), "part int, langs array<string>, n int, cell binary")
    return cells.groupBy("part").applyInArrow(_counted(least), "lang string, size int, phrase string, f long")


def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (l r)), in decimals of 38 digits: exact for counts up to 10 ** 15."""
    whole = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * ({whole(a)} * {whole(a)})) div ({whole(left)} * {whole(right)})")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST_COUNT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to three words.

    Text is lower-cased in A-Z and cut into pieces at .,;:!? and line ends;
    phrases lie within a piece, and all their occurrences count, overlapping ones
    too. Null, empty and blank texts have no words; a null lang is `und`; a very
    long text counts whole; repeated rows count each; rows of null doc_id count
    like any other. Ties in rank go by a, then by the phrase's bytes. Columns
    other than text and lang are left out, whatever their names. An empty table
    gives no rows.
    """
    arrow_rows(docs.sparkSession)
    chars = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    counts = written(gram_counts(chunks(docs), least, max(64, chars // PART_BYTES)), "grams")
    totals = counts.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.where(F.col("f") >= least)
    parts = lambda size, name: small_side(written(frequent.where(f"size = {size}").select("lang", F.col("phrase").alias(f"{name}_part"), F.col("f").alias(name)), "parts"), BROADCAST_PARTS)
    one, two = parts(1, "one"), parts(2, "two")
    cut = lambda k, n: F.array_join(F.slice(F.split("phrase", " "), k, n), " ")
    side = lambda df, name, to: df.withColumnsRenamed({f"{name}_part": f"{to}_part", name: to})

    def cuts(df, k, left, left_name, right, right_name, size):
        """The candidates with the counts and the score of the cut after k words."""
        own = df.withColumns({"l_part": cut(1, k), "r_part": cut(k + 1, size - k)})
        own = own.join(side(left, left_name, "l"), ["lang", "l_part"]).join(side(right, right_name, "r"), ["lang", "r_part"])
        return own.select("lang", "phrase", "a", F.struct(_score("a", "l", "r").alias("score"), F.lit(k).alias("k"), "l", "r").alias("c"))

    pairs, triples = (frequent.where(f"size = {size}").select("lang", "phrase", F.col("f").alias("a")) for size in (2, 3))
    around = triples.select("lang", F.explode(F.array(cut(1, 2), cut(2, 2))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = pairs.join(around.hint("merge"), ["lang", "phrase"], "left").where((F.col("longer").isNull()) | (100 * F.col("longer") < INSIDE_PERCENT * F.col("a"))).drop("longer")
    both = cuts(triples, 1, one, "one", two, "two", 3).unionByName(cuts(triples, 2, two, "two", one, "one", 3))
    scored = both.groupBy("lang", "phrase", "a").agg(F.min("c").alias("c")).unionByName(cuts(kept, 1, one, "one", one, "one", 2))
    scored = scored.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language's best are among the best of its parts, so that no task sorts a whole language.
    first = Window.partitionBy("lang", "part").orderBy(*order)
    few = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).drop("part", "rank")
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
