import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from almanac.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(low))
        groups.add((lang, source))
        df[lang].update(set(terms)), n[lang, source].update(terms), n[lang].update(terms)
    kept = {lang: [t for t, c in df[lang].items() if c >= least] for lang, _ in groups}
    share = lambda key, lang, t: 1 + 10**9 * (n[key][t] + 2) // (sum(n[key][x] for x in kept[lang]) + 2 * len(kept[lang]))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    ranked = lambda items: [(v, i, r) for r, (v, i) in enumerate(sorted(((v, i) for i, v in items), key=lambda x: (-x[0], x[1].encode())), 1)]
    out = []
    for lang, source in groups:
        p = {t: share((lang, source), lang, t) for t in kept[lang]}
        pair = [(s, sum(f(p[t], share((lang, s), lang, t)) for t in kept[lang])) for x, s in groups if x == lang and s != source]
        term = [(t, f(p[t], q)) for t in kept[lang] if n[lang, source][t] and p[t] > (q := share(lang, lang, t))]
        out += [(lang, source, "pair", i, v, r) for v, i, r in ranked(pair)] + [(lang, source, "term", i, v, r) for v, i, r in ranked(term) if r <= k]
    return sorted(out)


def documents():
    words = "Ärger zebra Zebra apple pear, naïve 中文 don't x-ray B2B".split()
    rows = []
    for i in range(160):
        text = " ".join(words[(i * j + j * j) % (3 + i % 8)] for j in range(i % 25))
        rows.append((text, ("en", "de", None, "")[i % 4], ("a", "b", None, "c", "é", "z")[i // 4 % 6]))
    return rows + [("tie one two three four", "fr", s) for s in "ab"] * 10 + [(None, "fr", "c"), ("", "xx", "a"), ("...", "xx", "b"), ("once", "yy", "only")] + [("same text " * 300, "en", "a")] * 12


@pytest.mark.parametrize(("held", "least"), [(400_000, 10), (3, 3)])
def test_against_brute_force(spark, monkeypatch, held, least):
    monkeypatch.setattr(divergence.counted, "__defaults__", (10, held))
    rows = documents()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, n int").repartition(3)
    assert sorted(map(tuple, divergence.audit(df, least).collect())) == brute(rows, least, 10)


def test_no_documents_and_no_kept_terms(spark):
    df = spark.createDataFrame([("a b", "en", "x"), ("a", "en", "y")], "text string, lang string, source string")
    assert divergence.audit(df.where("false")).count() == 0
    assert sorted(map(tuple, divergence.audit(df).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


@pytest.mark.parametrize(("bits", "few", "k"), [(11, 64, 10), (4, 0, 7)])
def test_radix_select_against_sorting(spark, bits, few, k):
    rows = [(g, "ab" * (i % 2) + f"{i * 7 % 113}é", v * 97) for g, n in (("a", 200), ("b", 3), ("c", 40)) for i in range(n) for v in [i % (2 if g == "c" else 9)]]
    df = spark.createDataFrame([(g, f"{t}{j}", v) for j, (g, t, v) in enumerate(rows)], "g string, item string, value long")
    got = divergence.select_top(df, ["g"], "value", "item", k, bits, few)
    kept = {g: sorted(((r.value, r["item"]) for r in got.where(F.col("g") == g).collect()), key=lambda x: (-x[0], x[1].encode())) for g in "abc"}
    for g in "abc":
        want = sorted(((r.value, r["item"]) for r in df.where(F.col("g") == g).collect()), key=lambda x: (-x[0], x[1].encode()))
        assert kept[g][:k] == want[:k] and len(kept[g]) <= k + few


def test_shares_are_exact(spark):
    cases = [(0, 3), (7, 19), (10**12, 7 * 10**12 + 1), (89 * 10**12, 8 * 10**14 + 7)]
    got = spark.createDataFrame(cases, "n long, base long").select("n", "base", divergence.share(F.col("n"), F.col("base")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 2) // r.base for r in got)
