import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from almanac.llm import simhash_texts

SCHEMA = "doc_id long, text string, sig string, row int"


def shingles(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_text_groups(rows):
    """rows: [(doc_id, text)] -> position of each row's group, by every pair of texts"""
    parent, sets = list(range(len(rows))), [shingles(t) for _, t in rows]

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and both:
            parent[find(j)] = find(i)
    return [find(i) for i in range(len(rows))]


def brute_kept(rows):
    best = {}
    for (d, t), g in zip(rows, brute_text_groups(rows), strict=True):
        best.setdefault(g, []).append((d is None, d or 0))
    return Counter(None if x[0] else x[1] for x in map(min, best.values()))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"q{rng.randrange(10**6)}"
    return " ".join(words)


def made(rng):
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(60, 300))) for _ in range(25)]
    texts = base + [edited(rng, b, rng.randint(1, 8)) for b in base for _ in range(4)] + [base[0].upper(), base[1] + " tail", base[2]]
    texts += [None, "", " \n\t", "one", "One", "one two", "a b c d e", "a b c d e f", "x" * 100_000, " ".join(["same"] * 5000), "é É " * 300]
    rows = [(i if i % 13 else i + 1, t, "clash", 1) for i, t in enumerate(texts)] + [(None, texts[0], "", 2), (None, "null id alone", "", 2), (3, texts[3], "", 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tree", [4096, 8])
def test_against_brute_force(spark, tree):
    rows = made(random.Random(tree))
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash_texts.dedup_texts(docs, tree=tree)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == brute_kept([r[:2] for r in rows])


def test_groups_and_a_chain_in_a_large_shard(spark):
    """Near copies of near copies: the ends of the chain are not alike, and most are not linked to the leader."""
    rng = random.Random(2)
    rows, words = [], [f"w{i}" for i in range(120)]
    for i in range(60):
        rows.append((100 + i, " ".join(words)))
        words[rng.randrange(len(words))] = f"n{i}"
    rows += [(i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(80))) for i in range(20)]
    want = brute_text_groups(rows)
    least = {g: min(d for (d, _), h in zip(rows, want) if h == g) for g in want}
    for tree in (4096, 6):
        got = simhash_texts.text_groups(spark.createDataFrame(rows, "doc_id long, text string"), tree=tree)
        assert {r.doc_id: r.group_id for r in got.collect()} == {d: least[g] for (d, _), g in zip(rows, want)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash_texts.dedup_texts(docs).count() == 0 and simhash_texts.text_groups(docs).count() == 0


def test_recall_of_pairs_at_the_least_similarity():
    """Of pairs of similarity 0.80 to 0.82, over 99.5 % share a band and lie within the radius."""
    rng, signer, found, n = np.random.default_rng(0), simhash_texts.Signer(5), 0, 3000
    for _ in range(n):
        size = int(rng.integers(60, 600))
        both = -(-8 * size // 9)  # of two sets of one size, this many shared give a similarity of 0.8
        h = rng.integers(0, 1 << 63, 2 * size - both, np.uint64)
        sets = [np.unique(simhash_texts._mix(x)) for x in (h[:size], h[size - both :])]
        a, b = (_signed(signer, s) for s in sets)
        found += ((a["fp"] ^ b["fp"]) & (2**64 - 1)).bit_count() <= simhash_texts.RADIUS and bool(set(a["bands"]) & set(b["bands"]))
    assert found / n > 0.995


def _signed(signer, own):
    signer.shingles = lambda _: own
    return signer.sign("")
