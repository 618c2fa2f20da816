"""Exact token counts: a histogram of encoded lengths answers every total by suffix sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import arrow_rows, texts, written
from .tokens import encoded, tokenizer_path

#: Lengths that share a block when suffix sums are made in two levels.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, path: str | None = None, by_word: bool = True) -> DataFrame:
    """doc_id and n_tokens of every whole text, very long ones too.

    Null text has 0 tokens, a repeated row counts again, equal lengths are no tie
    to break. Other columns, whatever their names, are left out; an empty table
    gives no rows.
    """
    arrow_rows(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches):
        for batch, _, at in encoded(batches, path, by_word):
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(at))], ["doc_id", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per occurring length, with what documents of that length or more hold.

    Columns: n_tokens, n_docs, docs_at_least, tokens_at_least (suffix sums),
    tokens_total and truncated_total, the corpus cut at n_tokens per document.
    Suffix sums run inside blocks of lengths and over the blocks' totals, so no
    task sees all lengths. An empty table gives no rows.
    """
    counts = written(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths").withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    mass = F.col("n_tokens") * F.col("n_docs")
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(mass).alias("t"))
    above = blocks.select("block", F.coalesce(F.sum("d").over(down), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(down), F.lit(0)).alias("t_above"), F.sum("t").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    return (
        counts.join(above.hint("merge"), "block")
        .select("n_tokens", "n_docs", (F.col("d_above") + F.sum("n_docs").over(inside)).alias("docs_at_least"), (F.col("t_above") + F.sum(mass).over(inside)).alias("tokens_at_least"), "tokens_total")
        .withColumn("truncated_total", F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
        .select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "tokens_total", "truncated_total")
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that are cut, and all tokens once every document is cut there."""
    over = F.col("n_tokens") > F.col("l")
    return (
        histogram.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("l"))
        .groupBy(F.col("l").alias("context_limit"))
        .agg(F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_cut"), F.sum(F.least("n_tokens", "l") * F.col("n_docs")).alias("truncated_total"))
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least `share` of the documents do not exceed, as one row n_tokens."""
    total = F.lit(histogram.agg(F.max("docs_at_least")).first()[0] or 0)
    return histogram.where(total - F.col("docs_at_least") + F.col("n_docs") >= F.ceil(total * F.lit(share))).agg(F.min("n_tokens").alias("n_tokens"))
