import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from almanac.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute_fp(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """fps: [(doc_id, fp)] -> {(doc_id, fp): component}"""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f, least.get(find(i))) for i, (d, f) in enumerate(fps)), key=str)


def near(rng, base, n):
    out = []
    for _ in range(n):
        words = base.split()
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 3
        out.append(" ".join(words))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(30)]
    texts = base + base[:5] + [b.upper() for b in base[5:8]] + near(rng, base[0], 20) + near(rng, base[1], 40)
    texts += [None, "", " \t\n", "one", "one two", "ONE two", "a b c", "x" * 50_000, "é É " * 1000, " a b c"]
    rows = [(i if i % 11 else i + 1, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "a b c", "", 2), (3, texts[3], "", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = simhash.groups(docs).select("doc_id", simhash.hexadecimal().alias("fp"), "component_id").collect()
    want = brute_groups([(r[0], brute_fp(r[1])) for r in rows])
    assert sorted(((r[0], int(r[1], 16), r[2]) for r in got), key=str) == want
    assert all(len(r[1]) == 16 for r in got)


def test_dense_shards_are_dealt_again_and_split(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(200)} | {0, 1, 2**64 - 1}
    dense = 0x1234_5678_9ABC_DEF0
    for _ in range(300):
        fps.add(dense ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for tree in (8, 64, 4096):
        roots = {r.u: r.root for r in simhash.components(simhash.links(df, 3, tree)).collect()}
        seen = {}
        for d, _, c in brute_groups([(i, f) for i, f in enumerate(fps)]):
            signed = int(np.uint64(fps[d]).astype(np.int64))
            seen.setdefault(c, set()).add(roots.get(signed, signed))
        assert all(len(v) == 1 for v in seen.values()), tree
        assert len({next(iter(v)) for v in seen.values()}) == len(seen), tree


def test_long_chain_of_links(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = simhash.components(edges).collect()
    assert {r.root for r in got} == {0} and len(got) == 300


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.groups(docs).count() == 0 and simhash.near_dedup(docs).count() == 0


def test_near_dedup_keeps_one_row_of_a_group(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(2, text, "b", 0), (1, text, "a", 0), (1, text, "a", 0), (1, "z " + text, "a", 0), (9, "other words here", "c", 0), (None, "q", "d", 0)]
    kept = simhash.near_dedup(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted((str(r.doc_id), r.fp) for r in kept.collect()) in ([("1", "a"), ("9", "c"), ("None", "d")],)


def test_near_dedup_keeps_one_row_of_each_group_of_null_and_repeated_ids(spark):
    rng = random.Random(3)
    text = [" ".join(f"{c}{rng.randrange(10_000)}" for _ in range(60)) for c in "abcdefg"]
    rows = [(None, text[0], "n0", 0), (None, text[0], "n0", 0), (None, text[1], "n1", 0), (None, None, "zero", 0), (None, " ", "zero", 0)]
    rows += [(7, text[2], "r2", 0), (7, text[3], "r3", 0), (7, text[3], "r3", 0)]  # two groups under one id
    rows += [(8, text[4], "r4", 0), (8, text[5], "r5", 0), (2, text[5], "least", 0)]  # one of two rows of an id is in another group
    rows += [(None, text[6], "null", 0), (5, text[6], "known", 0)]
    kept = simhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(2, text[5], "least"), (5, text[6], "known"), (7, text[2], "r2"), (7, text[3], "r3"), (8, text[4], "r4"), (None, text[0], "n0"), (None, text[1], "n1"), (None, None, "zero")]
    assert sorted(((r.doc_id, r.text, r.fp) for r in kept), key=str) == sorted(want, key=str)
