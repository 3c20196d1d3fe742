"""Phrase mining: against plain counting, for any sample, any cut of the texts, and its SQL."""

import random
import re
from collections import Counter

from checks import DATA, same_rows

from docket_spark.llm import phrases, queries

SCHEMA = "lang string, text string"


def plain_counts(rows, longest):
    """Counter of (lang, size, phrase) and of all words of a language."""
    found, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for size in range(1, longest + 1):
                found.update((lang, size, " ".join(words[i : i + size])) for i in range(len(words) - size + 1))
    return found, total


def plain(rows, least, longest, covered=50, best=2000):
    f, total = plain_counts(rows, longest)
    out = {}
    for (lang, size, phrase), a in f.items():
        if size < 2 or a < least:
            continue
        if any(g == lang and n > size and c >= least and 100 * c >= covered * a and f" {phrase} " in f" {q} " for (g, n, q), c in f.items()):
            continue
        w = phrase.split(" ")
        cuts = []
        for k in range(1, size):
            l, r = f[lang, k, " ".join(w[:k])], f[lang, size - k, " ".join(w[k:])]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), (phrase, a, l, r, total[lang], score)))
    return [(lang, i + 1, *x[3]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:best])]


def texts(seed=3, n=120):
    rng = random.Random(seed)
    signs = ["a", "B", "c", "the", "The", "É", "é", "x\x00y", "漢", "o'k", "-", " ", " "]
    joins = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r\n"]
    make = lambda: "".join(rng.choice(signs) + rng.choice(joins) for _ in range(rng.randrange(60)))
    rows = [(rng.choice(["en", "de", None, "und", ""]), make()) for _ in range(n)]
    return [*rows, *rows[:10], ("en", None), (None, ""), ("en", " . "), ("de", "one long tail " * 300)]


def show(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_equals_plain_counting_for_any_sample(spark):
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("text", "lang", "1 AS n", "'x' AS phrase", "lang AS size")
    expected = sorted(plain(rows, 5, 3))
    assert len(expected) > 50
    for sample, least in ((1.0, 5), (0.3, 2), (0.0, 1)):
        assert show(phrases.mine(df, least=5, sample=sample, sample_least=least)) == expected
    assert show(phrases.mine(df, least=5, best=7)) == sorted(plain(rows, 5, 3, best=7))


def test_longer_phrases_and_passes_until_closed(spark):
    rows = texts(9, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    assert show(phrases.mine(df, least=4, longest=5)) == sorted(plain(rows, 4, 5))
    whole, one = phrases.counts(df, 4, sample=1.0, sample_least=4)
    none, more = phrases.counts(df, 4, sample=0.0)
    assert one == 1 and 1 < more <= 4
    found, total = plain_counts(rows, 3)
    for got in (whole, none):
        assert {(r["lang"], r["size"], r["phrase"]): r["n"] for r in got.where("size > 0").collect()} == {k: n for k, n in found.items() if n >= 4}
        assert {r["lang"]: r["n"] for r in got.where("size = 0").groupBy("lang").sum("n").withColumnRenamed("sum(n)", "n").collect() if r["n"]} == {k: n for k, n in total.items() if n}


def test_cut_texts_count_the_same(monkeypatch):
    rows = texts(4, 30)
    found, total = plain_counts([("en", t) for _, t in rows], 3)
    for chunk in (7, 50, 1000):
        monkeypatch.setattr(phrases, "CHUNK", chunk)
        got = Counter()
        for size, words, n in phrases._counted("en", [t or "" for _, t in rows], 3, None, None, True):
            got.update({(size, p): int(c) for p, c in zip(words.to_pylist(), n)})
        assert got.pop((0, "")) == total["en"] and got == Counter({(s, p): n for (_, s, p), n in found.items()})


def test_scores_beyond_sixty_four_bits(spark):
    big = 3 * 10**15
    rows = [("en", 0, "", big * 3), ("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 1)]
    r = phrases.collocations(spark.createDataFrame(rows, phrases.COUNTS)).first()
    assert r["score"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 7)) and r["n"] == big * 3


def test_empty_table(spark):
    assert phrases.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark, duck):
    found = duck.sql(phrases.oracle_sql())
    same_rows(queries.op13_phrases(spark, DATA), found.columns, found.fetchall())
