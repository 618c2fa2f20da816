"""Near-duplicate groups by MinHash with tensored banding, every link confirmed.

Each document gets two small collections of SUBKEYS sub-keys, every sub-key the
hash of ROWS minima. A table key combines one sub-key of each collection, so
SUBKEYS ** 2 tables need 2 * SUBKEYS * ROWS minima. At similarity 0.75 a pair
meets in no table with probability 0.0009. Candidates are compared on their full
shingle sets.

Groups of copies are never paired off. Equal sets collapse first. Then rounds of
at most one pair a document link what is alike. The first round goes by stricter
keys, of four sub-keys each: these tell families of near-copies apart that share
table keys, and each document meets the first member of its fullest strict key.
In later rounds a key offers its best member, the one with the most key-mates over
all its keys, to the documents of other components, and each meets the best of those
that it has not met. A round that links few of its pairs is the last one. Keys that
still hold several components leave documents open; of these, pairs that exact bounds
on the sets cannot rule out are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, arrow_rows, small_side, texts, written
from ._text import LOWER, mix, ngrams, slices, utf8, word_hashes, words

SHINGLE = 5
PERCENT = 75
SUBKEYS = 14
ROWS = 3
#: Rounds by table keys at the most; what they leave goes to the exact bounds.
ROUNDS = 4
#: A round goes before another one only if it links one in so many of its pairs.
FRUITFUL = 10
#: Open documents of one component that have a core of common shingles, at the least.
CORE_LEAST = 8
#: A much-wanted hub is copied, so that each copy has about so many pairs.
PAIRS_A_COPY = 200

_RNG = np.random.Generator(np.random.PCG64(75))
_MINIMA = 2 * SUBKEYS * ROWS
_MUL = _RNG.integers(1, 1 << 63, (_MINIMA, 1), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, (_MINIMA, 1), dtype=np.uint64)
_ROLE = _RNG.integers(1, 1 << 63, (2 * SUBKEYS, 1), dtype=np.uint64)


def shingle_sets(column: pa.Array, n: int = SHINGLE):
    """The sorted distinct shingle hashes of each row; a text with fewer words is one shingle."""
    data, at = utf8(column)
    data = LOWER[data]
    start, end, before = words(data, at)
    hashes = word_hashes(data, start, end)
    grams, cut = ngrams(hashes, before, n)
    for k in range(len(at) - 1):
        own = grams[cut[k] : cut[k + 1]]
        if len(own):
            yield np.unique(own)
        elif before[k + 1] > before[k]:
            short, _ = ngrams(hashes[before[k] : before[k + 1]], np.array([0, before[k + 1] - before[k]]), int(before[k + 1] - before[k]))
            yield mix(short + np.uint64(before[k + 1] - before[k]))
        else:
            yield own


def minima(own: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set, in bounded blocks."""
    low = np.full(_MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 4096):
        x = own[i : i + 4096] * _MUL
        x += _ADD
        x ^= x >> np.uint64(29)
        np.minimum(low, x.min(axis=1), out=low)
    return low


def _signatures(batches):
    for batch in slices(batches):
        sizes, whole, keys = [], [], []
        for own in shingle_sets(batch.column("text")):
            sizes.append(len(own))
            if len(own):
                whole.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sub = minima(own).reshape(2 * SUBKEYS, ROWS, 1)
                total = _ROLE.copy()
                for r in range(ROWS):
                    total = mix(total + sub[:, r])
                keys.append(total[:, 0].astype(np.int64).tolist())
            else:
                whole.append(None)
                keys.append(None)
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_hash", "keys"],
        )


def _similar(batches):
    """Pairs (a, b) with both texts: keep those whose sets are similar enough."""
    for batch in slices(slices(batches, "a_text"), "b_text"):
        left = batch.column("a_text").dictionary_encode()
        index = left.indices.to_pylist()
        sets = list(shingle_sets(left.dictionary))
        keep = []
        for i, b in zip(index, shingle_sets(batch.column("b_text"))):
            a = sets[i]
            if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
                keep.append(False)
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(bool(100 * both >= PERCENT * (len(a) + len(b) - both) and both))
        mask = pa.array(keep, pa.bool_())
        yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def components(edges: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(node, comp): the smallest node that each node of the undirected edges (a, b) reaches.

    Labels pass to neighbours and through pointers (the label's own label), so
    the rounds grow with the logarithm of a chain's length. `first` gives known
    labels (node, comp). Hubs are safe: neighbours' labels join and fold as
    partial minima.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    nodes = both.select(F.col("u").alias("node")).distinct()
    if first is None:
        labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("comp"))
    else:
        labels = nodes.join(small_side(first), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    labels = written(labels, "labels")
    few = labels.count() <= BROADCAST_ROWS  # so many in all rounds
    side = lambda df: F.broadcast(df) if few else df.hint("merge")
    while True:
        near = both.join(side(labels.select(F.col("node").alias("v"), "comp")), "v").select(F.col("u").alias("node"), "comp", F.lit(None).cast("long").alias("was"))
        low = near.union(labels.select("node", "comp", F.col("comp").alias("was"))).groupBy("node").agg(F.min("comp").alias("comp"), F.max("was").alias("was"))
        jump = low.alias("x").join(side(labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))), "comp", "left")
        new = written(jump.select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "was"), "labels")
        labels = new.select("node", "comp")
        if not new.where("comp <> was").limit(1).count():
            return labels


def _confirmed(pairs: DataFrame, involved: DataFrame) -> DataFrame:
    """The similar ones of distinct pairs (a, b), written before; a much-wanted `a` is copied, its pairs dealt over the copies."""
    copies = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies")), "copies")
    dealt = pairs.join(small_side(copies), "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")))
    left = involved.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")).join(small_side(copies), "a").select("a", "a_text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)).alias("copy"))
    right = involved.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")).join(small_side(dealt), "b")
    return written(right.join(left.hint("merge"), ["a", "copy"]).select("a", "b", "a_text", "b_text").mapInArrow(_similar, "a long, b long"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text).

    Null or blank text has no shingles and no links; a very long one has all its
    shingles. Repeated rows give the same result each; rows that share a doc_id
    are taken to share their text. Rows of null doc_id link with nothing. Copies
    with equal sets (by 128 bits of all their shingles) are one node, and of ties
    the smallest doc_id names the group. Other columns, whatever their names, are
    left out. An empty table gives no rows.
    """
    arrow_rows(docs.sparkSession)
    rows = texts(docs)
    signs = written(rows.mapInArrow(_signatures, "doc_id long, n_shingles long, set_hash binary, keys array<long>"), "signatures")
    sets = signs.where("set_hash is not null and doc_id is not null")
    reps = sets.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys"))
    reps = written(reps.select("set_hash", "rep", "keys"), "sets")

    members = _members(reps)
    involved = _involved(rows, members.select(F.col("rep").alias("doc_id")).distinct())
    tried = written(_first_pairs(reps), "pairs")
    links = _confirmed(tried, involved)
    labels = components(links)
    for _ in range(ROUNDS):
        pairs = written(_partners(_open(members, labels), tried), "pairs")
        more = _confirmed(pairs, involved)
        made, linked = pairs.count(), more.count()
        if linked:
            links = written(links.union(more), "links")
            labels = components(links, labels)
        if linked * FRUITFUL < made or not made:
            break
        tried = written(tried.union(pairs), "tried")

    rest = written(_open(members, labels).select("rep", "comp").distinct(), "open")
    pairs = written(_across(rest, involved), "pairs")
    if pairs.limit(1).count():
        links = written(links.union(_confirmed(pairs, involved)), "links")
        labels = components(links, labels)

    by_set = reps.join(labels.select(F.col("node").alias("rep"), "comp").hint("merge"), "rep", "left").select("set_hash", "rep", F.coalesce("comp", "rep").alias("comp"))
    joined = signs.join(by_set.select(F.col("set_hash").alias("own"), "comp").hint("merge"), (F.col("set_hash") == F.col("own")) & F.col("doc_id").isNotNull(), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _members(reps: DataFrame) -> DataFrame:
    """(key, rep, degree) of table keys which several sets share; `degree` counts the set's mates over all its keys."""
    # Sub-keys that no other set has cannot be part of a shared table key.
    sub = reps.select("rep", F.posexplode("keys").alias("slot", "sub"))
    shared = written(sub.groupBy("sub").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("sub"), "shared")
    met = sub.join(small_side(shared), "sub").groupBy("rep").agg(
        F.collect_set(F.when(F.col("slot") < SUBKEYS, F.col("sub"))).alias("one"), F.collect_set(F.when(F.col("slot") >= SUBKEYS, F.col("sub"))).alias("two")
    )
    tables = met.select("rep", F.explode("one").alias("i"), "two").select("rep", "i", F.explode("two").alias("j")).select(F.xxhash64("i", "j").alias("key"), "rep")
    tables = written(tables, "keys")
    sizes = written(tables.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    members = written(tables.join(small_side(sizes), "key"), "members")
    degrees = written(members.groupBy("rep").agg(F.sum("n").alias("degree")), "degrees")
    return written(members.select("key", "rep").join(small_side(degrees), "rep").select("key", "rep", "degree"), "members")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, rep, degree, comp) of the members of keys that hold several components."""
    known = members.join(small_side(labels.select(F.col("node").alias("rep"), "comp")), "rep", "left").select("key", "rep", "degree", F.coalesce("comp", "rep").alias("comp"))
    known = written(known, "known")
    mixed = written(known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key"), "mixed")
    return known.join(small_side(mixed), "key").select("key", "rep", "degree", "comp")


def _first_pairs(reps: DataFrame) -> DataFrame:
    """One pair (a, b) for each document b that shares a strict key: with the smallest member of the fullest one."""
    k = F.col("keys")
    at = [(i, (i + 1) % SUBKEYS, SUBKEYS + i, SUBKEYS + (i + 1) % SUBKEYS) for i in range(SUBKEYS)] + [(i, (i + 2) % SUBKEYS, SUBKEYS + (i + 3) % SUBKEYS, SUBKEYS + (i + 5) % SUBKEYS) for i in range(SUBKEYS)]
    strict = written(reps.select("rep", F.explode(F.array(*[F.xxhash64(F.lit(n), *[k[i] for i in four]) for n, four in enumerate(at)])).alias("key")), "strict")
    full = written(strict.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1"), "full")
    best = strict.join(full.hint("merge"), "key").groupBy("rep").agg(F.max(F.struct("n", (-F.col("low")).alias("back"))).alias("x"))
    return best.select((-F.col("x.back")).alias("a"), F.col("rep").alias("b")).where("a <> b")


def _partners(open_: DataFrame, tried: DataFrame) -> DataFrame:
    """One pair (a, b) for each open document b that a key offers its best member of another component which b has not met: with the best of these.

    Of ties the smallest is best. Members of the best one's own component wait for the others to come.
    """
    open_ = written(open_, "mixed")
    best = open_.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("back"), "comp")).alias("x"))
    best = written(best.select("key", (-F.col("x.back")).alias("a"), F.col("x.degree").alias("mates"), F.col("x.comp").alias("most")), "best")
    offered = open_.join(small_side(best), "key").where("comp <> most").select(F.col("rep").alias("b"), "a", "mates")
    fresh = offered.join(small_side(tried), ["a", "b"], "left_anti")
    return fresh.groupBy("b").agg(F.max(F.struct("mates", (-F.col("a")).alias("back"))).alias("x")).select((-F.col("x.back")).alias("a"), "b")


def _involved(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of documents in some shared key, written once for all rounds; one text for each id."""
    ids = written(ids, "ids")
    few = rows.join(small_side(ids), "doc_id", "left_semi")
    return written(few.dropDuplicates(["doc_id"]), "involved")


def _shingle_rows(batches):
    for batch in slices(batches):
        own = list(shingle_sets(batch.column("text")))
        sizes = np.array([len(x) for x in own])
        repeat = lambda c: np.repeat(batch.column(c).to_numpy(), sizes)
        yield pa.record_batch([pa.array(repeat("rep")), pa.array(repeat("comp")), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))], ["rep", "comp", "n", "shingle"])


def _may_match(batches):
    """Rows (rep, comp, n, s): those for which some other size v has enough shared shingles that occur in sets of at least and at most v shingles."""
    for batch in batches:
        keep = []
        column = batch.column("s")
        flat, cut = column.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))])
        low, high = (pc.struct_field(flat, c).to_numpy() for c in ("low_n", "high_n"))
        for k, n in enumerate(batch.column("n").to_pylist()):
            lo, hi = np.sort(low[cut[k] : cut[k + 1]]), np.sort(high[cut[k] : cut[k + 1]])
            both = np.minimum(np.searchsorted(lo, lo, side="right") - np.searchsorted(hi, lo, side="left"), lo)
            keep.append(bool(((100 + PERCENT) * both >= PERCENT * (n + lo)).any()))
        yield batch.filter(pa.array(keep, pa.bool_()))


_SHARED = "rep long, comp long, n long, s array<struct<df:long,shingle:long,low_n:long,high_n:long>>"


def _across(open_: DataFrame, involved: DataFrame) -> DataFrame:
    """Pairs (a, b) of open documents in different components that may be similar enough, and all that are.

    Members of a key whose overlap is too small are told apart by exact bounds,
    without pairing them off. A document needs a possible partner's size at which
    enough of its shingles occur in documents of other components, whose sizes
    allow that; what this settles no longer counts for others, so the bound is
    taken twice. What is left meets by cores or by prefixes.
    """
    text = open_.join(involved.select(F.col("doc_id").alias("rep"), "text").hint("merge"), "rep").select("rep", "comp", "text")
    rows = written(text.mapInArrow(_shingle_rows, "rep long, comp long, n long, shingle long"), "shingles")
    for _ in range(2):
        seen = written(rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("low_n"), F.max("n").alias("high_n")).where("low < high").select("shingle", "df", "low_n", "high_n"), "frequencies")
        shared = rows.join(seen.hint("merge"), "shingle").groupBy("rep", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle", "low_n", "high_n"))).alias("s"))
        enough = written(shared.mapInArrow(_may_match, _SHARED), "enough")
        rows = enough.select("rep", "comp", "n", F.explode("s.shingle").alias("shingle"))
    # Shingles that no other component has come first in the order and match nothing.
    gone = F.col("n") - F.size("s")
    head = (F.col("n") - F.ceil(F.lit(PERCENT) * F.col("n") / 100) + 1 - gone).alias("head")
    short = (F.col("n") - F.ceil(F.lit(2 * PERCENT) * F.col("n") / (100 + PERCENT)) + 1 - gone).alias("short")
    flat = written(enough.select("rep", "comp", "n", head, short, F.posexplode("s.shingle").alias("at", "shingle")), "shared")
    large = written(enough.groupBy("comp").agg(F.count("*").alias("m")).where(F.col("m") >= CORE_LEAST), "large")
    if not large.count():
        return _by_prefixes(flat).distinct()
    core, like = _cores(flat, large)
    return _by_cores(flat, core, like).union(_by_prefixes(flat.join(like.select("rep").hint("merge"), "rep", "left_anti"))).distinct()


def _pair() -> list:
    return [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]


def _sizes_fit():
    return F.least("x.n", "y.n") * 100 >= PERCENT * F.greatest("x.n", "y.n")


def _cores(flat: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The core (comp, shingle) of each large component, what half of its open documents have, and the documents
    (rep, comp, n, outside) near it: those with no more shingles outside, as an array, than a prefix would have."""
    own = flat.join(small_side(large), "comp")
    core = written(own.groupBy("comp", "shingle").agg(F.count("*").alias("df"), F.first("m").alias("m")).where("2 * df >= m").select("comp", "shingle"), "cores")
    apart = own.join(core.withColumn("inside", F.lit(True)).hint("merge"), ["comp", "shingle"], "left")
    outside = F.collect_list(F.when(F.col("inside").isNull(), F.col("shingle"))).alias("outside")
    return core, written(apart.groupBy("rep", "comp", "n", "head").agg(outside).where(F.size("outside") <= F.col("head")).select("rep", "comp", "n", "outside"), "near")


def _by_cores(flat: DataFrame, core: DataFrame, like: DataFrame) -> DataFrame:
    """Pairs with a document y near its component's core: x has a shingle of y outside that core, or else
    the shingles that x has of the core are enough for a document of y's size."""
    y = like.select("rep", "comp", "n", F.explode("outside").alias("shingle")).alias("y")
    apart = flat.alias("x").join(y.hint("merge"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.comp") != F.col("y.comp")) & _sizes_fit()).select(*_pair())
    met = flat.alias("x").join(core.alias("y").hint("merge"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.comp") != F.col("y.comp")))
    common = met.groupBy("x.rep", "x.n", "y.comp").agg(F.count("*").alias("common"))
    most = F.floor(F.col("common") * (100 + PERCENT) / PERCENT - F.col("n"))
    common = written(common.withColumn("most", most).where(F.col("most") * 100 >= PERCENT * F.col("n")), "common")
    within = common.alias("x").join(like.alias("y").hint("merge"), (F.col("x.comp") == F.col("y.comp")) & (F.col("y.n") <= F.col("x.most")) & _sizes_fit())
    return apart.union(within.select(*_pair()))


def _by_prefixes(flat: DataFrame) -> DataFrame:
    """Pairs by prefixes: by ascending document frequency, two similar documents share a shingle among the first
    n - ceil(tn) + 1 of the larger one and the first n - ceil(2tn / (1 + t)) + 1 of the smaller. A shingle's most
    frequent component is not paired with itself."""
    prefix = written(flat.where("at < head").select("rep", "comp", "n", (F.col("at") < F.col("short")).alias("first"), "shingle"), "prefixes")
    most = prefix.groupBy("shingle", "comp").count().groupBy("shingle").agg(F.max_by("comp", F.struct("count", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1").select("shingle", "most")
    few = written(prefix.join(written(most, "most").hint("merge"), "shingle").where("comp != most").drop("most"), "few")
    fits = (F.col("x.comp") != F.col("y.comp")) & _sizes_fit() & F.when(F.col("x.n") < F.col("y.n"), F.col("x.first")).when(F.col("x.n") > F.col("y.n"), F.col("y.first")).otherwise(F.col("x.first") | F.col("y.first"))
    return few.alias("x").join(prefix.alias("y").hint("merge"), (F.col("x.shingle") == F.col("y.shingle")) & fits).select(*_pair())
