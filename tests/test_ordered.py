import random
from collections import defaultdict
from datetime import datetime, timedelta

from almanac.streaming import ordered
from tests.test_limits import attempts, plain

SCHEMA = "key string, id long, at long"


def streamed(spark, tmp_path, batches, name, late="10 minutes"):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name / f"b={k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(*[str(tmp_path / name / "b=*")])
        q = ordered.sliding_in_order(stream, late).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(150)
        return [(r.key, r.id, r.at, r.allowed) for r in spark.table(name).collect()], q.recentProgress
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_any_order_within_the_watermark_and_state_that_ends(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(attempts(500), key=lambda r: r[2] + rng.randrange(400_000))  # out of order by up to 400 s
    end = max(r[2] for r in rows)
    closing = [[("z", 10_000, end + 3_000_000)], [("z", 10_001, end + 30_000_000)], [("z", 10_002, end + 90_000_000)]]
    late = [[("a", 20_000, end - 3_000_000), ("z", 20_001, end + 90_000_001)]]
    nulls = [(None, 1, 5), ("a", None, 5), ("a", 1, None)]
    got, progress = streamed(spark, tmp_path, [rows[:170] + nulls, rows[170:340], rows[340:], *closing, *late], "kept")
    want = plain(rows)
    assert {i: ok for k, i, _, ok in got if k != "z"} == want and set(want.values()) == {True, False}
    sizes = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(sizes) >= 6 and sizes[-1] <= 2  # lists: of three keys what waits and what was allowed; at the end only z's


def brute(rows, days=7):
    out = []
    for block, target, at in rows:
        near = {t for b, t, x in rows if b == block and at - timedelta(days=days) <= x <= at}
        out.append((block, target, at, len(near)))
    return out


def made(n=400):
    rng = random.Random(9)
    t = datetime(2024, 1, 1)
    rows = [(rng.choice(["10.0.1.0/24", "10.0.2.0/24"]), rng.randrange(6), t + timedelta(hours=rng.randrange(24 * 60))) for _ in range(n)]
    return rows + rows[:20] + [("x", i, t + timedelta(days=7 * i)) for i in range(4)]  # repeats, and times exactly a span apart


def test_distinct_targets_at_every_moment(spark):
    rows = made()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows] + [(None, 1, rows[0][2], 1, 2), ("n", None, rows[0][2], 1, 2)], "block string, target long, at timestamp, moment int, change int")
    got = ordered.concurrent_targets(df).collect()
    assert sorted((r.block, r.target, r["at"], r.targets) for r in got if r.targets is not None) == sorted(brute(rows)) and len(got) == len(rows) + 2
    assert ordered.concurrent_targets(df.where("false")).count() == 0


def test_stretches_over_the_limit(spark):
    rows = made(120)
    df = spark.createDataFrame([(b.replace("0/24", f"{i % 9}") if b != "x" else None, t, at, "critical" if i % 7 else "low") for i, (b, t, at) in enumerate(rows)], "ip string, target long, at timestamp, risk string")
    kept = [(r.ip.rsplit(".", 1)[0] + ".0/24", r.target, r["at"]) for r in df.collect() if r.risk == "critical" and r.ip]
    by, want = defaultdict(dict), []
    for b, _, at, n in brute(kept):
        by[b][at] = n
    for b, times in by.items():
        run = None
        for at in sorted(times):
            if times[at] > 3:
                run = (b, run[1] if run else at, at, max(times[at], run[3] if run else 0))
            elif run:
                want.append(run)
                run = None
        want += [run] if run else []
    got = sorted((r.block, r.since, r.until, r.targets) for r in ordered.sudden(df).collect())
    assert got == sorted(want) and got
