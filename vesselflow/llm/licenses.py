"""License scans by diagonal voting, with DataFrame functions only.

All word 3-grams of the documents are hashed and joined to the 3-grams of the
license templates, a fixed small table; a hash that no template has is left out
before the join, and a hit counts only if its words are the template's. Hits vote
for (document, template, diagonal), the document's place less the template's. Diagonals near each other
merge, so inserted or missing words do not break a match, and a template counts
where the merged votes of some stretch, from any diagonal's first vote over twice
the template's length, cover enough of it. A base phrase stands where one
diagonal has all its 3-grams.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import driver_table, row_key, written

GRAM = 3
#: Diagonals this near to the one before belong to one match.
NEAR = 4
#: Share of a template's 3-grams that a match needs.
COVER = 0.6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose every exact place counts, with their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Passages of public licenses that the method looks for besides.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("the bsd 3 clause license", "bsd"),
    ("gnu general public license version 3", "gpl-3"),
    ("the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("creative commons attribution sharealike 4 0", "cc-by-sa"),
    ("creative commons attribution noncommercial 4 0", "cc-by-nc"),
    ("cc by sa 4 0", "cc-by-sa"),
    ("all rights reserved no part of this", "all-rights-reserved"),
)


def template_grams(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """gram, said (its words), template, place, grams (of the template), n (its words), label, base."""
    rows = []
    for i, (phrase, label) in enumerate((*base, *templates)):
        own = phrase.split()
        rows += [(i, k, len(own) - GRAM + 1, len(own), label, i < len(base), *own[k : k + GRAM]) for k in range(len(own) - GRAM + 1)]
    df = driver_table(spark, rows, **dict.fromkeys(("template", "place", "grams", "n"), pa.int32()), label=pa.string(), base=pa.bool_(), **dict.fromkeys("abc", pa.string()))
    return df.select(F.xxhash64("a", "b", "c").alias("gram"), F.array("a", "b", "c").alias("said"), "template", "place", "grams", "n", "label", "base")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("key", row_key(F.col("doc_id"), F.col("text")))


def hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, key, n_words and hits (at, gram, said: the 3-grams whose hash a template has) of every row, written, so that each text is split once."""
    split = _keyed(docs).select("doc_id", "key", F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("w"))
    own = sorted({r.gram for r in known.select("gram").collect()})  # of the fixed templates
    hashed = F.expr(f"transform(sequence(0, size(w) - {GRAM}), i -> struct(i as at, xxhash64(w[i], w[i + 1], w[i + 2]) as gram))")
    found = F.transform(F.filter(hashed, lambda x: x["gram"].isin(own)), lambda x: F.struct(x["at"].alias("at"), x["gram"].alias("gram"), F.slice("w", x["at"] + 1, GRAM).alias("said")))
    return written(split.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.when(F.size("w") >= GRAM, found).alias("hits")), "hits")


def spans(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """Verified matches, some inside others: key, label, base, start, end (words), cover (share of the template)."""
    known = template_grams(docs.sparkSession, base, templates)
    return matches(hits(docs, known), known, templates)


def matches(split: DataFrame, known: DataFrame, templates=TEMPLATES) -> DataFrame:
    """The same from the rows of `hits`."""
    grams = split.select("key", F.inline("hits"))
    same = (F.col("g.gram") == F.col("t.gram")) & (F.col("g.said") == F.col("t.said"))
    found = grams.alias("g").join(F.broadcast(known).alias("t"), same).drop(F.col("t.gram"), F.col("t.said"))
    votes = found.groupBy("key", "template", (F.col("at") - F.col("place")).alias("diagonal"), "grams", "n", "label", "base").agg(F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high"))
    votes = written(votes, "votes")  # few rows; both kinds of match read them
    exact = votes.where(F.col("base") & (F.size("places") == F.col("grams"))).select("key", "label", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n")).alias("end"), F.lit(1.0).alias("cover"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > NEAR) | (F.col("low") - F.lag("high").over(order) > F.col("n")), F.lit(True)).cast("int")
    merged = votes.where(~F.col("base")).withColumn("apart", apart).withColumn("match", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    reach = 2 * max((len(phrase.split()) for phrase, _ in templates), default=0)
    ahead = Window.partitionBy("key", "template", "match").orderBy("low").rangeBetween(0, reach)
    votes_ahead = F.collect_list(F.struct("high", "places")).over(ahead)
    inside = merged.withColumn("votes", F.filter(votes_ahead, lambda v: v["high"] + GRAM - F.col("low") <= 2 * F.col("n")))
    cover = F.size(F.array_distinct(F.flatten("votes.places"))) / F.col("grams")
    loose = inside.select("key", "label", "base", F.col("low").alias("start"), (F.array_max("votes.high") + GRAM).alias("end"), cover.alias("cover")).where(F.col("cover") >= COVER)
    return exact.unionByName(loose)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of (doc_id, text).

    Null text is empty, a very long one is scanned whole. A repeated row gives its
    result again, not twice the count. Without a match first_word and last_word
    are null, labels empty and the score 0. Of several matches the best cover is
    the score; ties change nothing. Other columns, whatever their names, are left
    out. An empty table gives no rows.
    """
    b = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    known = template_grams(docs.sparkSession)
    split = hits(docs, known)
    per = matches(split, known).groupBy("key").agg(
        F.count(F.when(b, 1)).alias("n_base"),
        F.min(F.when(b, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(b, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(b, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("cover").alias("score"),
    )
    counted = split.select("key", "doc_id", "n_words")
    none = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return counted.join(per.hint("merge"), "key", "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()}).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
