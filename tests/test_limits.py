import random

from almanac.streaming import limits
from pyspark.sql import functions as F


def plain(rows):
    held, out = {}, {}
    for key, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        recent = [t for t in held.get(key, []) if at - t < 3_600_000]
        ok = sum(at - t < 60_000 for t in recent) < 10 and len(recent) < 30
        held[key] = recent + [at] * ok
        out[i] = ok
    return out


def attempts(n=2500, seed=3):
    rng = random.Random(seed)
    return [(rng.choice("abc"), i, 1_700_000_000_000 + rng.randrange(4_000_000)) for i in range(n)]


def test_blocked_attempts_use_nothing_up(spark):
    rows = attempts()
    got = {r.id: r.allowed for r in limits.sliding(spark.createDataFrame(rows, "key string, id long, at long")).collect()}
    assert got == plain(rows) and set(got.values()) == {True, False}


def test_stream_keeps_state_between_batches(spark, tmp_path):
    rows = sorted(attempts(600), key=lambda r: (r[2], r[1]))
    for k in range(3):
        spark.createDataFrame(rows[k * 200 : k * 200 + 200], "key string, id long, at long").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema("key string, id long, at long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = limits.sliding_stream(stream).writeStream.format("memory").queryName("slid").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.id: r.allowed for r in spark.table("slid").collect()}
    assert got == plain(rows)


def test_event_time_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="complete"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(180)
        return {tuple(map(str, r)) for r in spark.table(name).collect()}

    same = lambda df: {tuple(map(str, r)) for r in df.collect()}
    assert run(limits.tumbling(stream, "1 day").drop("total"), "tumbled") == same(limits.tumbling(events, "1 day").drop("total"))
    keyed = lambda df: df.select("user_id", "event_type", "ts")
    assert {r[:2] for r in run(limits.first_votes(keyed(stream), ["user_id", "event_type"], "60 days"), "voted", "append")} == {r[:2] for r in same(keyed(events))}


def test_stored_limits(spark):
    day = limits.DAY
    row = lambda i, at, **k: (i, at, k.get("fp", "f"), k.get("ip"), k.get("email"), k.get("risk", "low"), k.get("parent"))
    rows = [row(i, i) for i in range(11)] + [row(20, day + 11), row(21, 12, fp=None)] + [row(30 + i, i, fp="g", risk="critical") for i in range(3)] + [row(40 + i, i, fp="h", parent=1) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, at long, fingerprint string, ip string, email string, risk string, parent int")
    got = {r.id: r.reason for r in limits.limit_reason(df).collect()}
    assert [i for i, r in got.items() if r == "fingerprint_day"] == [10] and [i for i, r in got.items() if r == "critical_day"] == [32]
    assert sum(r is not None for r in got.values()) == 2
