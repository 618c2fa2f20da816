"""Periodic runs, collocations and SimHash groups against brute force, on a small table and on hard rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from vesselflow.llm import collocations, periodic, queries, simhash

from test_text_operators import DOCS, LONG, LOW, PASSAGE, SF, WORD, empty, expect, got_rows, hard, rows_of


@pytest.fixture(scope="module", params=["table", "hard"])
def docs(spark, request):
    return (spark.read.parquet(f"{SF}/documents.parquet") if request.param == "table" else hard(spark)).cache()


# --- periodic runs -----------------------------------------------------------


def brute_runs(words, least=6):
    """Every maximal stretch with smallest period q and length of max(least, 4 q), by comparing each word with the one q on."""
    number = {}
    x = np.array([number.setdefault(w, len(number)) for w in words])
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2], edge[1::2]):
            length = int(b - a + q)
            if length < max(least, 4 * q):
                continue
            own = x[a : a + length]
            if all((own[p:] != own[:-p]).any() for p in range(1, q) if q % p == 0):
                out.append((int(a), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(words):
    """The operator's runs of one list of words, without Spark."""
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    _, start, end, period = periodic._document_runs(ids, np.array([0, len(ids)]))
    return [(int(a), int(b - a), int(q)) for a, b, q in zip(start, end, period)]


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_parts(parts):
    words = list("".join(part * times for part, times in parts))
    assert runs_of(words) == brute_runs(words)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=120))
def test_runs_of_few_letters(text):
    assert runs_of(list(text)) == brute_runs(list(text))


def test_runs_at_all_scales():
    """Long periods with few repeats, short ones with thousands, runs in runs, and words in between."""
    rng = random.Random(4)
    for period in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100, 127, 129, 300):
        for times in (3, 4, 5, 11):
            base = [rng.choice("abcd") if period < 20 else rng.choice("ab") for _ in range(period)]
            words = ["u", "v"] + base * times + base[: period // 2] + ["w"] + ["z"] * 9
            assert runs_of(words) == brute_runs(words), (period, times)
    inner = (["x"] * 40 + ["y"]) * 30
    assert runs_of(inner) == brute_runs(inner)
    morse = [bin(i).count("1") % 2 for i in range(4096)]
    assert runs_of(morse) == brute_runs(morse) == []
    assert runs_of(["a"] * 5) == [] and runs_of(["a"] * 6) == [(0, 6, 1)] and runs_of([]) == []


def test_runs_of_many_documents_at_once():
    rng = random.Random(9)
    rows = [[rng.choice("ab") for _ in range(rng.choice((0, 1, 5, 40, 300)))] * rng.choice((1, 4)) for _ in range(60)]
    number = {"a": 0, "b": 1}
    ids = np.array([number[w] for r in rows for w in r], np.int64)
    row, start, end, period = periodic._document_runs(ids, np.cumsum([0] + [len(r) for r in rows]))
    got = [[] for _ in rows]
    for k, a, b, q in zip(row, start, end, period):
        got[k].append((int(a), int(b - a), int(q)))
    assert got == [brute_runs(r) for r in rows]


def test_periodic_runs(docs):
    got = {(r.doc_id, r.collapsed): (r.n_words, [tuple(x) for x in r.runs]) for r in periodic.periodic_runs(docs).collect()}
    want = {}
    for i, t in rows_of(docs):
        words = WORD.findall(t)
        runs = brute_runs(words) if len(words) < 20_000 else []  # the long ones have no repeats
        want[i, collapsed(words, runs)] = (len(words), runs)
    assert got == want


def test_periodic_runs_query(spark):
    want = []
    for i, t in rows_of(spark.read.parquet(f"{SF}/documents.parquet")):
        words = planted(i, WORD.findall(t))
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        want.append((i, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    got = queries.op11_periodic_runs(spark, SF)
    expect(got, ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"), want)
    assert got.where("n_runs > 0").count() > 5


def test_planted_stretches_of_hard_rows(spark):
    got = [(r.doc_id, WORD.findall(r.text or "")) for r in queries.repeating(hard(spark)).collect()]
    assert sorted(got, key=repr) == sorted([(i, planted(i, WORD.findall(t))) for i, t in rows_of(hard(spark))], key=repr)
    odd = spark.createDataFrame([(None, PASSAGE), (None, None)], "doc_id long, text string")
    assert got_rows(queries.repeating(odd), "doc_id", "text") == [(None, PASSAGE), (None, None)]


def test_a_very_long_text_of_one_period(spark):
    words = [f"p{i % 5000}" for i in range(400_000)]
    got = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words)), (2, "x " * 300_000)], "doc_id long, text string")).collect()
    assert [[tuple(x) for x in r.runs] for r in got] == [[(0, 400_000, 5000)], [(0, 300_000, 1)]]
    assert got[0].collapsed == " ".join(words[:5000]) and got[1].collapsed == "x"


# --- collocations ------------------------------------------------------------


def brute_collocations(rows, top=2000, least=10):
    f = {}
    for lang, text in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for g, c in own.items() if len(g) == 1)
        cand = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        around, kept = Counter(), []
        for g, a in cand.items():
            for i in range(len(g) - 2 + 1):
                if len(g) == 3:
                    around[g[i : i + 2]] = max(around[g[i : i + 2]], a)
        for g, a in cand.items():
            if around[g] and 100 * around[g] >= 50 * a:
                continue
            score, k = min((1000000 * a * a // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_collocations(spark, docs):
    if "hard" in str(docs.select("lang").distinct().collect()):
        pytest.skip()
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    expect(collocations.collocations(docs), COLUMNS, brute_collocations(rows))
    expect(collocations.collocations(docs, top=7, least=2), COLUMNS, brute_collocations(rows, 7, 2))


def test_collocations_of_odd_texts(spark):
    """Repeated words, pieces of every length, one hot passage, odd separators, ties, null languages."""
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "C", "é", "é", "x\x1cy", " ", "ZZ", "😀"])
    rows = [(rng.choice(["en", "de", None, ""]), "".join(word() + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "!?", "\r\n", "\x0b"]) for _ in range(rng.choice((1, 2, 3, 60))))) for _ in range(150)]
    rows += [("en", "a a a a a a a a a a a a a a a a")] * 3 + [("en", PASSAGE)] * 40 + [(None, None), ("de", ""), ("de", " .. ")]
    df = spark.createDataFrame([(None, lang, t, "c", 1) for lang, t in rows], "doc_id long, lang string, text string, chunk string, f int")
    expect(collocations.collocations(df), COLUMNS, brute_collocations(rows))


def test_each_gram_is_counted_in_one_chunk(spark):
    """The dictionary's weighted grams are the texts' grams, whatever the chunks."""
    rng = random.Random(1)
    text = " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(3000))
    df = spark.createDataFrame([(1, "en", text), (2, "en", text), (3, "en", "a. b c, a")], "doc_id long, lang string, text string")
    pieces = [text.split(), text.split(), ["a"], ["b", "c"], ["a"]]
    want = Counter(" ".join(p[i : i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
    parsed = collocations.chunks(df).cache()
    assert {r.phrase: r.f for r in collocations.gram_counts(parsed, 1).collect()} == want
    assert parsed.where("times > 1").count() > 100 and parsed.agg({"starts": "max"}).first()[0] < 200


def test_scores_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13 - 1, 10**13, 10**13 + 7), (10**15 - 1, 10**15 - 1, 10**15 - 1), (3, 5, 7)], "a long, l long, r long")
    got = [tuple(r) for r in df.select("a", "l", "r", collocations._score("a", "l", "r")).collect()]
    assert got == [(a, left, r, 1000000 * a * a // (left * r)) for a, left, r, _ in got]


# --- SimHash -----------------------------------------------------------------


def brute_print(text):
    w = WORD.findall(text.translate(LOW))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_simhash_groups(prints):
    """(doc_id, print) pairs in groups by single linkage at four bits."""
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    order = sorted(range(len(prints)), key=lambda i: prints[i][0])
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                a, b = find(i), find(j)
                if a != b:
                    a, b = sorted((a, b), key=lambda k: prints[k][0])
                    top[b] = a
    return [(i, f"{p:016x}", prints[find(k)][0]) for k, (i, p) in enumerate(prints)]


def test_simhash(docs):
    want = brute_simhash_groups([(i, brute_print(t)) for i, t in rows_of(docs)])
    expect(simhash.simhash_groups(docs), ("doc_id", "fingerprint", "component_id"), want)


def near_prints():
    """Balls of prints, chains of four bits a step, and prints just apart."""
    rng = random.Random(7)
    out = []
    for _ in range(12):
        base = rng.getrandbits(64)
        out += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(40)]
        for _ in range(20):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice((4, 5))))
            out.append(base)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("range_variants", [simhash.RANGE_VARIANTS, 20_000, 300])
def test_ball_hashing_links_all_near_prints(spark, range_variants):
    """The same groups whether ranges are whole or cut to a few variants."""
    prints = near_prints()
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), range_variants).collect()
    at = {p: k for k, p in enumerate(signed)}
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for r in found:
        a, b = sorted((find(at[r.a]), find(at[r.b])))
        top[b] = a
    want = brute_simhash_groups(list(enumerate(prints)))
    assert [find(k) for k in range(len(prints))] == [c for _, _, c in want]


def test_simhash_of_rows_without_id_and_of_repeated_ids(spark):
    df = spark.createDataFrame([(None, PASSAGE), (4, PASSAGE), (None, None), (3, PASSAGE.upper()), (9, None), (8, " "), (3, LONG)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.simhash_groups(df).collect()]
    assert sorted(got, key=repr) == sorted([(None, None), (4, 3), (None, None), (3, 3), (9, 8), (8, 8), (3, 3)], key=repr)


def test_long_texts_count_in_blocks(monkeypatch, spark):
    df = spark.createDataFrame([(1, LONG), (2, PASSAGE), (3, "a b"), (4, PASSAGE + " " + LONG)], "doc_id long, text string")
    want = got_rows(simhash.fingerprints(df), "doc_id", "print")
    raw = " ".join(f"k{i % 90}" for i in range(500)).encode()
    start = np.array([m.start() for m in re.finditer(rb"\S+", raw)])
    end = np.array([m.end() for m in re.finditer(rb"\S+", raw)])
    row = np.sort(np.random.default_rng(1).integers(0, 5, len(start)))
    whole = simhash.fingerprint_bits(raw, start, end, row, 6)
    monkeypatch.setattr(simhash, "COUNT_AT_ONCE", 7)
    assert (simhash.fingerprint_bits(raw, start, end, row, 6) == whole).all() and whole[5] == 0
    assert [p % 2**64 for _, p in want] == [brute_print(t) for t in (LONG, PASSAGE, "a b", PASSAGE + " " + LONG)]


# --- all three ---------------------------------------------------------------


def test_empty_tables(spark):
    none = empty(spark)
    assert none.schema == DOCS
    for df in (periodic.periodic_runs(none), collocations.collocations(none), simhash.simhash_groups(none), queries.repeating(none)):
        assert df.count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(blank).count() == 0 and periodic.periodic_runs(blank).where("size(runs) = 0 and collapsed = ''").count() == 2
