import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import topk


def brute(rows, queries, k):
    out = []
    for qid, q in dict(queries).items():
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i is not None and v is not None and i != qid and len(v) == len(q)))
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, vectors, queries, k=5, **how):
    frame = lambda x: spark.createDataFrame([(i, v, "c", 1, 1, 1, "b", 1) for i, v in x], "vec_id long, q array<long>, score string, rank int, dim int, block int, vectors string, team int")
    return sorted(tuple(r) for r in topk.top_k(frame(vectors), frame(queries), k, **how).collect())


@pytest.mark.parametrize("dropped", [0, 1, 4])
@pytest.mark.parametrize("spread", [2, 300, 10**9])
def test_index_is_exact(dropped, spread):
    rng = np.random.default_rng(spread + dropped)
    rows = rng.integers(-spread, spread + 1, (1000, 13))
    rows[100:500] = rows[7]
    index = topk.Index(rows, dropped)
    for query in rng.integers(-spread, spread + 1, (12, 13)):
        for k in (1, 5, 700, 1000, 2000):
            at, score = index.best(query, k)
            exact = rows @ query
            want = np.lexsort((np.arange(1000), -exact))[:k]
            assert (at == want).all() and (score == exact[want]).all()


def test_bit_slices_prune():
    rng = np.random.default_rng(0)
    rows = np.floor(256 * rng.normal(0, 0.125, (8192, 64))).astype(np.int64)
    index = topk.Index(rows)
    assert np.mean([len(index.candidates(q, 5)) for q in rows[:20]]) < 100


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [int(x) for x in rng.integers(-40, 40, 8)]) for i in rng.permutation(900)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)] + [(7, rows[0][1])] * 3 + [(None, rows[1][1]), (3000, None), (3001, []), (3002, [1, 2, 3]), (3050, [4, 5, 6])]
    rows += [(4000, []), (4001, []), (4050, [])]
    queries = [(i, v) for i, v in rows if i is not None and i % 50 == 0 and v is not None]
    queries = list(dict(queries).items())
    assert run(spark, rows, queries, rows=128, per=4) == brute(rows, queries, 5)
    assert run(spark, rows[:3], [(1, rows[0][1])], 5) == brute(rows[:3], [(1, rows[0][1])], 5)


def test_quantise_and_empty(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [None, 1.0]), (3, [float("nan")]), (4, [float("-inf")]), (5, None), (6, [])], "vec_id long, e array<float>")
    got = {r.vec_id: r.q for r in df.select("vec_id", topk.quantise(F.col("e")).alias("q")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
    assert run(spark, [], []) == [] and run(spark, [(1, [1])], []) == [] and run(spark, [], [(1, [1])]) == []
