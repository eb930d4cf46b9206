import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from almanac.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, mix int"


def brute_targets(sizes):
    """The loop that the contract states."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, done = 1.5 * sum(sizes.values()), {}
    while len(done) < len(order):
        rest, free = total - sum(done.values()), [s for s in order if s not in done]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 2.0 * sizes[s] for s in over}
    return done


def brute_mix(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    goal, out = brute_targets(sizes), []
    for source, total in sizes.items():
        own = sorted((int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16), d is not None, d or 0, len((t or "").encode().split()), d) for d, t, s in rows if s == source)
        budget = int(goal[source] + 1e-9)
        epochs = budget // total if total else 0
        rest = budget - epochs * total
        for *_, n, d in own:
            got = min(n, max(0, rest))
            rest -= n
            out.append((str(d), n, total, epochs * n + got))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def got(spark, rows):
    name = mixing.mix_column(frame(spark, rows))
    assert name == "mix_"
    return sorted((str(r.doc_id), r[name].size, r[name].source_size, r[name].taken) for r in mixing.mix(frame(spark, rows)).collect())


def test_against_brute_force(spark):
    rows = [(i, "w " * (i * 37 % 91), f"s{i % 3 if i % 2 else 0}") for i in range(200)]
    rows += [(500, None, "a"), (501, "", None), (502, "x y", None), (None, "p q r", "s1"), (503, "one", "Zz"), (504, "é é\x1cb", "é"), (505, "l " * 20_000, "s2")]
    rows += [(7, rows[7][1], rows[7][2])] * 5
    assert got(spark, rows) == brute_mix(rows)


@given(st.dictionaries(st.sampled_from(["a", "b", "c", "d", None, "Z", "é"]), st.integers(0, 60), min_size=1, max_size=6))
@settings(max_examples=12, deadline=None)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    out = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert out.keys() == want.keys() and all(abs(out[s] - want[s]) < 1e-6 for s in out)


def test_repeated_rows_at_the_cut(spark):
    rows = [(1, "a b c", "s")] * 10 + [(2, "x " * 6, "t")]
    assert got(spark, rows) == brute_mix(rows)


def test_mixture_rows(spark):
    rows = [(i, f" a{i}\tb  c\nd ", "big" if i < 40 else "small") for i in range(50)]
    docs = frame(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert rows[r.doc_id][1].startswith(r.text)
    assert {(str(d), n) for d, n in words.items()} == {(d, taken) for d, _, _, taken in brute_mix(rows) if taken}


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0
    assert got(spark, [(1, None, None), (2, "", "a")]) == [("1", 0, 0, 0), ("2", 0, 0, 0)]
