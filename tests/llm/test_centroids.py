import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanac.llm import centroids


def brute(rows, k, rounds):
    rows = [(i, q) for i, q in rows if q is not None]
    mark = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centers = [list(q) for _, q in sorted(((mark(i), q) for i, q in rows))[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        held = {}
        for _, q in rows:
            held.setdefault(near(q)[1], []).append(q)
        centers = [[sum(x) // len(x) for x in zip(*held[j])] if j in held else c for j, c in enumerate(centers)]
    found = [(i, *near(q)) for i, q in rows]
    total = sum(d for _, d, _ in found)
    own = lambda j: sum(d for _, d, x in found if x == j)
    return sorted(((i, j, d, own(j), total, hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, d, j in found), key=str)


@pytest.mark.parametrize(("size", "segment", "k"), [(64, 8, 16), (5, 2, 3), (7, 8, 30)])
def test_against_brute_force(spark, size, segment, k):
    rng = np.random.default_rng(size)
    rows = [(i if i % 9 else None, rng.integers(-40, 40, size).tolist()) for i in range(200)]
    rows += [(3, rows[3][1])] * 20 + [(500 + i, [0] * size) for i in range(30)] + [(900, None)]  # repeats, ties, nulls
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, q array<long>, cluster int, sums int")
    assert sorted(map(tuple, centroids.cluster(df, k, 3, segment).collect()), key=str) == brute(rows, k, 3)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3, 4]), (3, None)], "vec_id long, q array<long>")
    assert sorted(map(tuple, centroids.cluster(df).collect())) == brute([(1, [1, 2]), (2, [3, 4])], 16, 3)
    empty = centroids.cluster(df.where("vec_id > 5"))
    assert empty.count() == 0 and empty.columns == centroids.cluster(df).columns


def test_quantise_leaves_out_what_takes_no_part(spark):
    rows = [(1, [0.5, -0.01]), (2, [1.0]), (3, None), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("-inf")]), (7, [])]
    df = spark.createDataFrame(rows, "i long, x array<float>").select("i", centroids.quantise(F.col("x"), 2).alias("q"))
    assert {r.i: r.q for r in df.collect()} == {1: [32, -1]} | dict.fromkeys(range(2, 8))


def test_components_too_large_are_an_error(spark):
    df = spark.createDataFrame([(1, [1 << 40, 2])], "vec_id long, q array<long>")
    with pytest.raises(Exception, match="components too large"):
        centroids.cluster(df).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 20), st.sampled_from([1, 30, 2000, centroids.largest(20)]))
def test_screening_never_loses_the_nearest(seed, segment, size):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-size, size + 1, (80, 20)), rng.integers(-size, size + 1, (9, 20))
    x[:20] = c[rng.integers(0, 9, 20)]  # at a centroid
    c[5] = c[2]  # ties
    label, best, tested = centroids.screened(x, *centroids.compress(x, segment), c, segment)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (label == d.argmin(1)).all() and (best == d.min(1)).all() and 80 <= tested <= 80 * 9


def test_most_distances_are_screened_where_there_are_clusters():
    rng = np.random.default_rng(1)
    c = rng.integers(-500, 500, (32, 64))
    x = c[rng.integers(0, 32, 4000)] + rng.integers(-20, 20, (4000, 64))
    assert centroids.screened(x, *centroids.compress(x), c)[2] < 1.1 * len(x)
