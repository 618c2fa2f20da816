"""Exact top-k by inner product over an impact-ordered posting index, score at a time.

Vectors are cut into index blocks. A block keeps, for each dimension, postings in
segments of one quantised impact: the rows whose value there has that size and
sign. Queries take the segments of all dimensions by descending impact and add up
impact times query component. A query stops when what its vectors have in segments
not taken yet, bounded by the norms of query and remainder, proves that all but a
few vectors cannot reach the k-th sum so far; segments of lower impact are then
skipped for it, and the few are rescored exactly. Without a proof it goes on to
the last segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

K = 20
SCALE = 64
QUERY_EACH = 20
BLOCK = 8192
#: Queries packed together; each index block goes once to each such group.
GROUP = 4096
#: Queries of a group that a block scores at once.
AT_ONCE = 256
#: Impacts are cut to so many bits; what is cut off counts as remainder.
IMPACT_BITS = 8
#: A proof is tried when the remainders' mean norm has fallen to this part of its last one.
TRY_EACH = 0.75
#: Queries for which a proof is tried before the others.
TRY_FIRST = 16
#: Values of a block; vectors wider than 64 components get blocks of fewer rows.
BLOCK_VALUES = 64 * BLOCK
#: The search stops when at most one in so many vectors is left to rescore.
RESCORE_EACH = 8

PACKED = "part long, ids binary, vectors binary, bytes int"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and whole-number components, floor(scale * x); vectors null, empty, or holding null or non-finite components are left out."""
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(sound & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("q"))


def _pack(whole: DataFrame, parts: int) -> DataFrame:
    """Rows dealt by hash into `parts` packed blocks, shorter vectors filled up with zeros."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        table = table.sort_by("vec_id")
        rows = table.column("q").to_pylist()
        width = max(map(len, rows))
        x = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            x[i, : len(r)] = r
        ids = table.column("vec_id").to_numpy()
        kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
        return pa.table([pa.array([part]), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([np.dtype(kind).itemsize], pa.int32())], ["part", "ids", "vectors", "bytes"])

    return whole.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("long")).groupBy("part").applyInArrow(run, PACKED)


def _unpack(vectors: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(vectors, f"i{width}").reshape(n, -1).astype(np.int64)


class Block:
    """One index block: posting segments by descending impact, and the norm of each vector's remainder below each impact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        size = np.abs(x)
        self.most = int(size.max(initial=0))
        shift = max(0, self.most.bit_length() - IMPACT_BITS)
        row, dim = np.nonzero(size >> shift)
        value = x[row, dim]
        impact = np.abs(value) >> shift
        # Segments: impact from the highest, dimension, sign; rows in order within each.
        order = np.lexsort((row, value > 0, dim, -impact))
        row, dim, value, impact = row[order], dim[order], value[order], impact[order]
        new = np.ones(len(row) + 1, bool)
        new[1:-1] = (impact[1:] != impact[:-1]) | (dim[1:] != dim[:-1]) | ((value[1:] > 0) != (value[:-1] > 0))
        cut = np.flatnonzero(new)
        self.rows, self.cut, self.dim = row, cut, dim[cut[:-1]]
        self.score = np.where(value[cut[:-1]] > 0, 1, -1) * (impact[cut[:-1]] << shift)
        # The levels: segments of one impact, and what is left of each vector after them.
        self.level = np.flatnonzero(np.diff(impact[cut[:-1]], prepend=-1, append=-1)) if len(row) else np.zeros(1, np.int64)
        left = (x.astype(np.float64) ** 2).sum(axis=1)
        cut_off = value - np.sign(value) * (impact << shift)
        saved = value.astype(np.float64) ** 2 - cut_off.astype(np.float64) ** 2
        self.left = []
        for a, b in zip(cut[self.level[:-1]], cut[self.level[1:]]):
            left = left - np.bincount(row[a:b], saved[a:b], len(x))
            self.left.append(np.sqrt(np.maximum(left, 0)))

    def search(self, wanted: np.ndarray, asked: np.ndarray, k: int):
        """For each query id and vector: ids and scores that hold the block's best k, the query's own row left out."""
        n, width = self.x.shape
        q = np.zeros((len(asked), width), np.int64)
        common = min(width, asked.shape[1])
        q[:, :common] = asked[:, :common]
        few = max(4 * k, n // RESCORE_EACH)
        can = self._possible(wanted, q, k, few) if n > few else [np.arange(n)] * len(q)
        for i, rows in enumerate(can):
            rows = rows[self.ids[rows] != wanted[i]]
            score = self.x[rows] @ q[i]
            best = np.lexsort((self.ids[rows], -score))[:k]
            yield self.ids[rows][best], score[best]

    def _ruled(self, sums: np.ndarray, left: np.ndarray, norm: np.ndarray, own: np.ndarray, k: int, few: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the rows that may still be among its best k, and whether they are few."""
        bound = norm[:, None] * (left * (1 + 1e-6) + 1e-12 * self.most * self.x.shape[1]) + 1
        got = sums.T.astype(np.float64)
        least = got - bound
        here = np.flatnonzero(own >= 0)
        least[here, own[here]] = -np.inf
        got += bound
        may = got >= np.partition(least, len(left) - k, axis=1)[:, len(left) - k, None]
        return may, may.sum(axis=1) <= few

    def _possible(self, wanted: np.ndarray, q: np.ndarray, k: int, few: int) -> list[np.ndarray]:
        """For each query the rows that its segments taken cannot rule out."""
        n = len(self.x)
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        kind = np.float32 if np.abs(q.astype(np.float64)).sum(axis=1).max() * max(self.most, 1) < 1 << 24 else np.float64
        # A wrong digit of such sums is part of the margin below.
        sums, open_, can = np.zeros((n, len(q)), kind), np.arange(len(q)), [np.arange(n)] * len(q)
        weight = q.T.astype(kind)
        own = np.searchsorted(self.ids, wanted)
        own = np.where((own < n) & (self.ids[np.minimum(own, n - 1)] == wanted), own, -1)
        tried = np.inf
        for at, left in enumerate(self.left):
            for s in range(self.level[at], self.level[at + 1]):
                sums[self.rows[self.cut[s] : self.cut[s + 1]]] += self.score[s] * weight[self.dim[s]]
            last = at + 1 == len(self.left)
            if left.mean() > TRY_EACH * tried and not last:
                continue
            tried = left.mean()
            # Where a few queries have no proof, the others wait for the next try.
            if not last and not self._ruled(sums[:, :TRY_FIRST], left, norm[open_[:TRY_FIRST]], own[open_[:TRY_FIRST]], k, few)[1].any():
                continue
            may, proved = self._ruled(sums, left, norm[open_], own[open_], k, few)
            proved |= last
            for j in np.flatnonzero(proved):
                can[open_[j]] = np.flatnonzero(may[j])
            if proved.any():
                open_, sums, weight = open_[~proved], np.ascontiguousarray(sums[:, ~proved]), np.ascontiguousarray(weight[:, ~proved])
            if not len(open_):
                break
        return can


def _cells(k: int):
    def run(batches):
        index, block = None, None
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if index != row["part"]:
                    ids = np.frombuffer(row["ids"], np.int64)
                    index, block = row["part"], Block(ids, _unpack(row["vectors"], len(ids), row["bytes"]))
                every = np.frombuffer(row["q_ids"], np.int64)
                vectors = _unpack(row["q_vectors"], len(every), row["q_bytes"])
                for at in range(0, len(every), AT_ONCE):
                    wanted = every[at : at + AT_ONCE]
                    out = list(block.search(wanted, vectors[at : at + AT_ONCE], k))
                    count = [len(ids) for ids, _ in out]
                    yield pa.record_batch([pa.array(np.repeat(wanted, count)), pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out]))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, query_each: int = QUERY_EACH, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other vectors, ties to the smaller id.

    Queries are the rows whose vec_id is divisible by `query_each`. Vectors that
    are null, empty, or hold null or non-finite components take no part; missing
    components of a shorter vector count as 0. A row that repeats a vec_id is
    one vector, any of its rows. Components beyond 2 ** 63 / 64 in size are beyond
    what the index holds, and scores beyond 64 bits what a score holds. Columns other than vec_id and embedding, whatever their
    names, are left out. An empty table gives no rows.
    """
    whole = written(quantised(vectors).dropDuplicates(["vec_id"]), "vectors")
    asked = whole.where(F.col("vec_id") % query_each == 0)
    n, width = whole.agg(F.count("*"), F.max(F.size("q"))).first()
    rows = max(256, min(block, BLOCK_VALUES // (width or 1)))
    blocks, groups = max(1, -(-n // rows)), max(1, -(-asked.count() // group))
    index = written(_pack(whole, blocks), "index")
    queries = written(_pack(asked, groups), "queries").select(F.col("part").alias("g"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("bytes").alias("q_bytes"))
    cells = index.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    spread = cells.join(queries.hint("merge"), "g").join(index.select("part", "ids", "vectors", "bytes").hint("merge"), "part")
    dealt = spread.repartition(max(1, min(blocks * groups, 100_000)), "part", "g").sortWithinPartitions("part")
    found = dealt.select("part", "ids", "vectors", "bytes", "q_ids", "q_vectors", "q_bytes").mapInArrow(_cells(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
