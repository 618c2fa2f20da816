"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models.

Two first-order Markov models over one alphabet are trained from labelled
samples: random strings (digests of document ids written in several alphabets,
and the values that the fixed patterns found) against ordinary identifiers (long
words of a bounded sample of documents, plain and joined by an underscore). A
long token counts as a secret if its mean log-likelihood ratio exceeds that of
nearly all ordinary identifiers in the sample.

Spans come from the pieces between matches: a match starts where the pieces and
matches before it end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import row_key, small_side, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models judge: this long at least, over the models' alphabet.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Documents whose long words are the sample of ordinary identifiers, the first ones by a hash of their id.
SAMPLE_ROWS = 1000
#: Digests that are the sample of random strings, each written in three alphabets.
SAMPLE_DIGESTS = 3000
#: Share of ordinary identifiers that may score over the limit.
FALSE_SHARE = 0.0005
MASK = "[SECRET]"


def _base(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _base(F.col("text")).alias("text")).withColumn("key", row_key(F.col("doc_id"), F.col("text")))


def _matches(rows: DataFrame, pattern: str, value_group: int = 0) -> DataFrame:
    """Every leftmost match of (key, text): key, start, end, value; a pattern that matches no empty string."""
    p = F.lit(pattern)
    found = rows.select("key", F.monotonically_increasing_id().alias("row"), F.split("text", pattern, -1).alias("piece"), F.regexp_extract_all("text", p, F.lit(0)).alias("match"), F.regexp_extract_all("text", p, F.lit(value_group)).alias("value"))
    each = found.select("key", "row", F.posexplode(F.arrays_zip("piece", "match", "value")).alias("i", "x")).where("x.match is not null")
    before = Window.partitionBy("key", "row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("x.piece") + F.length("x.match")).over(before)
    return each.select("key", (end - F.length("x.match")).alias("start"), end.alias("end"), F.col("x.value").alias("value"))


def base_spans(rows: DataFrame) -> DataFrame:
    """key, kind (its place in KINDS), start, end, value of the fixed patterns."""
    has_mark = F.contains("text", F.lit("=")) | F.contains("text", F.lit(":"))
    kinds = (
        (0, rows.where(has_mark & F.col("text").rlike(ASSIGN)), ASSIGN, 2),
        (1, rows.where(F.contains("text", F.lit("AKIA"))), ACCESS, 0),
        (2, rows.where(F.col("text").rlike(HEX)), HEX, 0),
    )
    out = None
    for kind, some, pattern, group in kinds:
        own = _matches(some, pattern, group).select("key", F.lit(kind).alias("kind"), "start", "end", "value")
        own = own.where(F.length("value") >= ASSIGN_VALUE) if kind == 0 else own
        out = own if out is None else out.union(own)
    return out


def _code(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def samples(rows: DataFrame, base: DataFrame) -> DataFrame:
    """(value, random): the labelled samples."""
    first = rows.join(F.broadcast(rows.select("key").orderBy("key").limit(SAMPLE_ROWS)), "key", "left_semi")
    words = first.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{7,}"), F.lit(0))).alias("w")).distinct()
    plain = words.select(F.col("w").alias("value")).union(words.select(F.concat("w", F.lit("_"), F.lower("w")))).union(words.select(F.concat("w", F.initcap("w"))))
    ids = rows.sparkSession.range(SAMPLE_DIGESTS).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    raw = F.unhex("h")
    digests = ids.select(F.substring(F.base64(raw), 1, 40).alias("value")).union(ids.select(F.substring("h", 1, 40))).union(ids.select(F.substring(F.regexp_replace(F.upper(F.base64(raw)), "[^A-Z0-9]", ""), 1, 24)))
    values = base.select(F.substring("value", 1, 64).alias("value")).distinct().orderBy(F.xxhash64("value"), "value").limit(SAMPLE_DIGESTS)
    return plain.withColumn("random", F.lit(False)).union(digests.union(values).withColumn("random", F.lit(True)))


def fit(sample: DataFrame) -> tuple[list[float], float]:
    """The models' log-likelihood ratios, flat by (character, next), and the limit of the mean ratio.

    Only the pair counts reach the driver, two for each pair of the alphabet.
    """
    size = len(ALPHABET)
    pairs = sample.select("random", F.explode(F.expr("transform(sequence(1, greatest(length(value) - 1, 1)), i -> substring(value, i, 2))")).alias("p"))
    coded = pairs.select("random", _code(F.substring("p", 1, 1)).alias("a"), _code(F.substring("p", 2, 1)).alias("b")).where("a > 0 and b > 0")
    counts = {(r.random, r.a - 1, r.b - 1): r["count"] for r in coded.groupBy("random", "a", "b").count().collect()}
    ratio = []
    for a in range(size):
        whole = [sum(counts.get((k, a, b), 0) for b in range(size)) + size / 2 for k in (False, True)]
        ratio += [math.log((counts.get((True, a, b), 0) + 0.5) / whole[1]) - math.log((counts.get((False, a, b), 0) + 0.5) / whole[0]) for b in range(size)]
    limit = sample.where(~F.col("random")).agg(F.percentile(mean_ratio(F.col("value"), ratio), F.lit(1 - FALSE_SHARE))).first()[0]
    return ratio, max(limit or 0.0, 0.0)


def mean_ratio(value: Column, ratio: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's character pairs; characters outside the alphabet are passed over."""
    size = len(ALPHABET)
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")

    def add(total, i):
        a, b = _code(F.substring(value, i, F.lit(1))), _code(F.substring(value, i + 1, F.lit(1)))
        return total + F.when((a > 0) & (b > 0), F.element_at(table, (a - 1) * size + b)).otherwise(0.0)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(value) - 1, F.lit(1))), F.lit(0.0), add) / F.greatest(F.length(value) - 1, F.lit(1))


def all_spans(rows: DataFrame) -> DataFrame:
    """key, kind, start, end of every secret: the fixed patterns' spans, and judged tokens that none of these covers whole."""
    base = written(base_spans(rows), "secrets")
    ratio, limit = fit(samples(rows, base))
    tokens = _matches(rows.where(F.col("text").rlike(TOKEN)), TOKEN)
    judged = tokens.where(mean_ratio(F.col("value"), ratio) > limit).select("key", F.lit(3).alias("kind"), "start", "end")
    mine, theirs = judged.alias("m"), base.select("key", "start", "end").distinct().alias("b")
    covered = (F.col("m.key") == F.col("b.key")) & (F.col("m.start") >= F.col("b.start")) & (F.col("m.end") <= F.col("b.end"))
    return written(base.select("key", "kind", "start", "end").distinct().union(mine.join(theirs.hint("merge"), covered, "left_anti").distinct()), "secrets")


def _digest(some: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(some), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of (doc_id, text).

    Null text is empty, a very long one is scanned whole. Spans are in code points,
    end exclusive, by start and then kind; spans of one start and kind are one.
    Other columns, whatever their names, are left out. Without spans the lists are empty strings (base_sha256 is the
    digest of one). A repeated row gives its result again. An empty table gives
    no rows.
    """
    rows = keyed(docs)
    spans = F.collect_set(F.struct("start", "kind", "end")).alias("all")
    per = all_spans(rows).groupBy("key").agg(spans)
    base = F.filter("all", lambda x: x["kind"] < 3)
    count = lambda k: F.coalesce(F.size(F.filter("all", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    per = per.select("key", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("all")).alias("spans"))
    none = {"n_assign": F.lit(0), "n_access": F.lit(0), "n_hex": F.lit(0), "base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    joined = rows.select("key", "doc_id").join(small_side(written(per, "found")), "key", "left")
    return joined.withColumns({c: F.coalesce(c, v) for c, v in none.items()}).drop("key")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced by MASK; overlapping spans become one.

    The columns of `docs` stay, whatever their names; n_chars follows the text.
    Null text stays null, very long texts are masked whole, repeated rows alike;
    an empty table gives no rows.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("doc"), F.col("text").cast("string").alias("text"), row_key(F.col("doc_id"), _base(F.col("text"))).alias("key"))
    found = all_spans(keyed(docs)).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("secrets"))
    step = F.expr(
        "aggregate(secrets, named_struct('at', 0L, 'out', ''), (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', "
        f"if(s.start < a.at, a.out, concat(a.out, substring(text, int(a.at + 1), int(s.start - a.at)), '{MASK}'))), "
        "a -> concat(a.out, substring(text, int(a.at + 1))))"
    )
    out = rows.join(small_side(written(found, "found")), "key", "left").withColumn("masked", F.when(F.col("secrets").isNull(), F.col("text")).otherwise(step))
    new = {"text": F.col("masked"), "n_chars": F.when(F.col("secrets").isNull(), F.col("doc").getField("n_chars")).otherwise(F.length("masked").cast("long")) if "n_chars" in columns else None}
    return out.select([new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in columns])
