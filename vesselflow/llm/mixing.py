"""Mixing overlapping sources to target sizes by min-cost flow.

Documents fold into membership patterns, the sets of sources that hold them. A
pattern's words flow to the quotas of its sources; each further pass over a
pattern costs more than the one before, so words repeat only where quotas need
it. Documents are then chosen inside each pattern in the order of a seeded hash:
whole passes for all, and one partial pass up to the word where the flow ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import driver_table, small_side, written

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_PASSES = 2
SEED = 20240131
#: A pattern's documents fall into so many hash buckets; only the one where the flow ends is sorted.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_PASSES) -> dict:
    """Each source's share of `share_percent` of all words by repeating weights, none above `most` times its size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, list(order), sum(sizes.values()) * share_percent / 100
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


class Flow:
    """Min-cost flow by cheapest augmenting paths over a graph of patterns and sources."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        while True:
            best, by, queue = {s: 0}, {}, [s]
            for a in queue:  # grows while nodes get cheaper
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] > 0 and best[a] + self.cost[e] < best.get(b, 1 << 60):
                        best[b], by[b] = best[a] + self.cost[e], e
                        queue.append(b)
            if t not in by:
                return
            path, b = [], t
            while b != s:
                path.append(by[b])
                b = self.to[by[b] ^ 1]
            step = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step


def route(capacity: dict[tuple, int], quota: dict, most: int = MOST_PASSES) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources: all quotas as far as they can be met, repeats as rare as they can be."""
    patterns, sources = list(capacity), list(quota)
    s, t = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    flow, kept = Flow(t + 1), {}
    at = {x: len(patterns) + i for i, x in enumerate(sources)}
    for i, p in enumerate(patterns):
        for turn in range(most):
            flow.edge(s, i, capacity[p], turn * turn)
        kept[p] = {x: flow.edge(i, at[x], most * capacity[p], 0) for x in p}
    for x in sources:
        flow.edge(at[x], t, round(quota[x]), 0)
    flow.run(s, t)
    return {p: {x: flow.room[e ^ 1] for x, e in edges.items()} for p, edges in kept.items()}


@dataclass
class Mix:
    """A plan: bounds has a row per pattern, edge the documents of the buckets where flows end."""

    bounds: DataFrame
    edge: DataFrame
    sizes: dict
    targets: dict


def _key(members: Column) -> Column:
    """A pattern's name; None and any string differ."""
    return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(members, lambda s: F.when(s.isNull(), "-").otherwise(F.concat(F.lit("s"), F.hex(s)))))))


def _bucket(seed: int) -> tuple[Column, Column]:
    order = F.xxhash64(F.lit(seed), "doc_id")
    return order, F.pmod(F.shiftrightunsigned(order, 20), F.lit(BUCKETS)).cast("int")


def plan(sized: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_PASSES, seed: int = SEED) -> Mix:
    """Plan a mix of (doc_id, members array<string>, size long), a table written before.

    What reaches the driver is one row per membership pattern.
    """
    spark = sized.sparkSession
    patterns = sized.groupBy(_key(F.col("members")).alias("pattern")).agg(F.first("members").alias("members"), F.sum("size").alias("size")).collect()
    capacity = {tuple(sorted(set(r.members), key=lambda s: (s is None, s or ""))): (r.pattern, r.size or 0) for r in patterns}
    sizes: dict = {}
    for p, (_, n) in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, weights, share_percent, most)
    routed = route({p: n for p, (_, n) in capacity.items()}, goal, most)
    rows = []
    for p, (name, n) in capacity.items():
        words = sum(routed[p].values())
        rows.append((name, words // n if n else 0, words % n if n else 0))
    bounds = driver_table(spark, rows, pattern=pa.string(), passes=pa.int64(), rest=pa.int64())

    order, bucket = _bucket(seed)
    dealt = sized.select(_key(F.col("members")).alias("pattern"), "doc_id", "size", order.alias("h"), bucket.alias("bucket"))
    filled = dealt.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = filled.withColumn("before", before).join(F.broadcast(bounds), "pattern").where("before <= rest and rest < before + words").select("pattern", F.col("bucket").alias("end"), "before")
    ends = written(ends, "ends")
    bounds = written(bounds.join(F.broadcast(ends), "pattern", "left").select("pattern", "passes", "rest", F.coalesce("end", F.lit(BUCKETS)).alias("end"), F.coalesce("before", "rest").alias("before")), "bounds")
    inside = Window.partitionBy("pattern").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = dealt.join(F.broadcast(bounds), "pattern").where("bucket = end").withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    # Rows that repeat a doc_id share what the flow gives them, evenly up to a word.
    edge = written(edge.groupBy("pattern", "doc_id").agg(F.sum("part").alias("part"), F.count("*").alias("copies")).where("part > 0"), "edge")
    return Mix(bounds, edge, sizes, goal)


def take(sized: DataFrame, mix: Mix, seed: int = SEED) -> DataFrame:
    """Adds `taken`: whole passes, and of the partial pass the words before the flow's end."""
    _, bucket = _bucket(seed)
    named = sized.withColumn("pattern", _key(F.col("members"))).withColumn("bucket", bucket)
    bound = named.join(F.broadcast(mix.bounds), "pattern", "left")
    ended = bound.join(small_side(mix.edge), ["pattern", "doc_id"], "left")
    partial = F.when(F.col("bucket") < F.col("end"), F.col("size")).otherwise(F.coalesce(F.expr("part div copies"), F.lit(0)))
    return ended.withColumn("taken", F.col("passes") * F.col("size") + partial).drop("pattern", "bucket", "passes", "rest", "end", "before", "part", "copies")


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of (doc_id, source, text).

    Null text has no words and a very long one all its words; null is a source of
    its own, last in order; repeated rows count each; ties of the seeded hash of
    doc_id, which makes reruns agree, go by doc_id. Other columns, whatever their
    names, are left out. An empty table gives no rows.
    """
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")).withColumn("members", F.array("source")), "sizes")
    own = plan(sized)
    spark = docs.sparkSession
    per = driver_table(spark, [(s, own.sizes[s], float(own.targets[s])) for s in own.sizes], of=pa.string(), source_size=pa.int64(), target=pa.float64())
    return take(sized, own).join(F.broadcast(per), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: a row for each pass over a document, the last one cut to its words.

    The columns of `docs` stay, whatever their names. Null and empty texts have no
    words and go; very long texts count whole; repeated rows count each; an empty
    table gives no rows.
    """
    columns = docs.columns
    sized = docs.select(F.struct(*columns).alias("_doc"), "doc_id", "text", F.array(F.col("source").cast("string")).alias("members"), word_count(F.col("text")).alias("size"))
    own = plan(written(sized.select("doc_id", "members", "size"), "sizes"))
    passes = take(sized, own).withColumn("turn", F.explode(F.when(F.col("taken") > 0, F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size")))))
    left = F.col("taken") - F.col("turn") * F.col("size")
    cut = F.when(left < F.col("size"), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")).otherwise(F.col("text"))
    new = {"text": cut, "n_chars": F.when(left < F.col("size"), F.length(cut).cast("long")).otherwise(F.col("_doc.n_chars") if "n_chars" in columns else None)}
    return passes.select([new[c].alias(c) if c in new else F.col("_doc").getField(c).alias(c) for c in columns])
