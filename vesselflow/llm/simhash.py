"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints at distance 4 or less have a variant in common at distance 2 or
less from each. So every distinct fingerprint stands for all its variants within
half the radius, and fingerprints that share a variant are a candidate pair, which
is verified by its differing bits.

Variants meet by ranges of their leading bits. A fingerprint goes once to each
range in which it has variants, 56 ranges at 10 leading bits rather than 2,081
variants, and the range's task writes the variants out, sorts them and links the
members of each to the smallest. The number of leading bits grows with the number
of fingerprints; a range with too many variants is cut by more bits, so that no
task gathers a whole group of near copies. A range passes on one link a member.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_rows, texts, written
from ._text import LOWER, slices, spaced, utf8, words
from .neardup import components

SHINGLE = 4
SEED = 42
BITS = 64
RADIUS = 4
#: Fingerprints that a range of variants has as its own, about.
RANGE_FINGERPRINTS = 400
LEAST_PREFIX, MORE_PREFIX = 8, 8
#: Variants of a range at the most; beyond it the range is cut.
RANGE_VARIANTS = 4_000_000
#: Shingles whose bits are counted at once.
COUNT_AT_ONCE = 1 << 16


def fingerprint_bits(raw: bytes, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The SimHash of each row as an unsigned number: bits set in over half its shingles raw[start:end]; without any, zero."""
    ones, count = np.zeros((rows, BITS), np.int64), np.bincount(row, minlength=rows)
    for i in range(0, len(start), COUNT_AT_ONCE):
        a, b, own = start[i : i + COUNT_AT_ONCE], end[i : i + COUNT_AT_ONCE], row[i : i + COUNT_AT_ONCE]
        h = np.fromiter((xxhash.xxh64_intdigest(raw[x:y], SEED) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(a))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def _fingerprints(batches):
    for batch in slices(batches):
        data, at = utf8(batch.column("text"))
        data = LOWER[data]
        start, end, before = words(data, at)
        raw, begin, stop = spaced(data, start, end)
        n = np.diff(before)
        shingles = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        row = np.repeat(np.arange(len(n)), shingles)
        first = np.arange(len(row)) + np.repeat(before[:-1] - (np.cumsum(shingles) - shingles), shingles)
        last = first + np.minimum(n, SHINGLE)[row] - 1
        prints = fingerprint_bits(raw, begin[first], stop[last], row, len(n))
        yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print, the SimHash of all shingles of a row's words as a signed 64-bit number; a text without words has 0."""
    return texts(docs).mapInArrow(_fingerprints, "doc_id long, print long")


def masks(width: int, radius: int) -> list[int]:
    """All numbers of `width` bits with at most `radius` of them set."""
    return [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(width), k)]


def _share(spare, more: int, half: int):
    """A row for each difference in `more` bits that is within the distance `spare`."""
    every = F.array(*[F.lit(m) for m in masks(more, half)]).cast("array<long>")
    return F.explode(F.filter(every, lambda m: F.bit_count(m) <= spare))


def _cut(rows: DataFrame, more: int, half: int) -> DataFrame:
    """Rows (prefix, bits, spare, print) dealt to ranges of `more` further bits; spare is the distance that variants there may still have."""
    mask = rows.withColumn("mask", _share(F.col("spare"), more, half))
    own = F.expr(f"shiftrightunsigned(shiftleft(print, bits), {BITS - more})")
    return mask.select(F.shiftleft("prefix", more).bitwiseOR(own.bitwiseXOR(F.col("mask"))).alias("prefix"), (F.col("bits") + more).cast("int").alias("bits"), (F.col("spare") - F.bit_count("mask")).cast("int").alias("spare"), "print")


def _variants(width, spare):
    """How many variants of `width` bits lie within the distance `spare`, for a half radius of two."""
    return F.when(spare == 0, F.lit(1)).when(spare == 1, 1 + width).otherwise(1 + width + width * (width - 1) / 2)


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The links of one range of variants: each member and the smallest that it reaches through shared variants."""
    width = BITS - key[1].as_py()
    prints = table.column("print").to_numpy()
    spare = table.column("spare").to_numpy()
    members, of = np.unique(prints, return_inverse=True)
    low = prints.view(np.uint64) & np.uint64((1 << width) - 1)
    variant, who = [], []
    for left in np.unique(spare):
        own = np.flatnonzero(spare == left)
        near = np.array(masks(width, int(left)), np.uint64)
        variant.append((low[own, None] ^ near).ravel())
        who.append(np.repeat(of[own], len(near)))
    variant, who = np.concatenate(variant), np.concatenate(who).astype(np.int32)
    order = np.argsort(variant, kind="stable")
    variant, who = variant[order], who[order]
    same = variant[1:] == variant[:-1]
    shared = np.zeros(len(variant), bool)
    shared[1:] |= same
    shared[:-1] |= same
    variant, who = variant[shared], who[shared]
    a = b = np.zeros(0, np.int64)
    if len(who):
        first = np.flatnonzero(np.append(True, variant[1:] != variant[:-1]))
        lead = np.repeat(np.minimum.reduceat(who, first), np.diff(np.append(first, len(who))))
        pair = np.unique(lead.astype(np.int64) * len(members) + who)
        x, y = pair // len(members), pair % len(members)
        apart = np.bitwise_count((members[x] ^ members[y]).view(np.uint64))
        x, y = x[(x != y) & (apart <= RADIUS)], y[(x != y) & (apart <= RADIUS)]
        label = np.arange(len(members))
        while True:  # the smallest member reached inside this range
            new = label.copy()
            np.minimum.at(new, x, label[y])
            np.minimum.at(new, y, label[x])
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(members)))
        a, b = members[label[moved]], members[moved]
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(prints: DataFrame, range_variants: int = RANGE_VARIANTS) -> DataFrame:
    """(a, b): links between distinct prints (print) that give the same groups as all pairs at distance RADIUS or less."""
    half = RADIUS // 2
    n = prints.count()
    leading = LEAST_PREFIX
    while n > RANGE_FINGERPRINTS << leading and leading < 40:
        leading += 1
    whole = prints.select(F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("bits"), F.lit(half).alias("spare"), "print")
    rows = _cut(whole, leading, half)
    while True:
        load = rows.groupBy("prefix", "bits").agg(F.sum(_variants(BITS - F.col("bits"), F.col("spare"))).alias("load"))
        heavy = written(load.where((F.col("load") > range_variants) & (F.col("bits") <= BITS - MORE_PREFIX)).select("prefix", "bits"), "heavy")
        if not heavy.count():
            break
        rows = written(rows, "ranges")
        keys = ["prefix", "bits"]
        rows = rows.join(heavy.hint("merge"), keys, "left_anti").unionByName(_cut(rows.join(heavy.hint("merge"), keys, "left_semi"), MORE_PREFIX, half))
    return rows.groupBy("prefix", "bits").applyInArrow(_meet, "a long, b long")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row of (doc_id, text).

    Null, empty and blank texts have fingerprint zero and link like any other; a
    very long text counts all its shingles, repeats too. Equal fingerprints are
    one node, and of ties the smallest doc_id names the group. Repeated rows give
    the same result each; two rows that share a doc_id but not their text are
    each in their fingerprint's group. Rows of null doc_id have a fingerprint and
    link with nothing, so that their component_id is null. Other columns, whatever
    their names, are left out. An empty table gives no rows.
    """
    arrow_rows(docs.sparkSession)
    signs = written(fingerprints(docs), "fingerprints")
    nodes = written(signs.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("low")), "prints")
    found = written(links(nodes.select("print")), "links")
    groups = nodes.join(components(found).withColumnRenamed("node", "print").hint("merge"), "print", "left").select("print", "low", F.coalesce("comp", "print").alias("comp"))
    named = written(groups.groupBy("comp").agg(F.min("low").alias("component_id")), "groups")
    by_print = written(groups.join(named.hint("merge"), "comp").select(F.col("print").alias("own"), "component_id"), "groups")
    joined = signs.join(by_print.hint("merge"), (F.col("print") == F.col("own")) & F.col("doc_id").isNotNull(), "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
