"""Limits on events: over stored rows by range windows, over attempts by state that blocked attempts don't enter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from almanac.operators.walk import walked

DAY, WEEK = 86_400_000_000, 7 * 86_400_000_000
#: Fixed values: (column, window in microseconds, most, reason), the first that is reached counts.
STORED = (("fingerprint", DAY, 10, "fingerprint_day"), ("fingerprint", WEEK, 30, "fingerprint_week"), ("ip", DAY, 20, "ip_day"), ("ip", WEEK, 60, "ip_week"), ("email", DAY, 10, "email_day"))
CRITICAL = 2
#: Sliding windows of signals, in milliseconds: (length, most).
SIGNALS = ((60_000, 10), (3_600_000, 30))


def limit_reason(rows: DataFrame) -> DataFrame:
    """``rows`` (id, at long in microseconds, fingerprint, ip, email, risk, parent) with ``reason``: the first limit that the
    rows stored within its window before had reached, as if the row had just come; null if none. Rows with a parent don't
    count; null keys have no limit."""
    critical, counted = F.col("risk") == "critical", F.col("parent").isNull().cast("int")
    tests = [(k, span, most, name, counted) for k, span, most, name in STORED] + [("fingerprint", DAY, CRITICAL, "critical_day", F.when(critical, counted).otherwise(0))]
    hit = {name: n >= most if name != "critical_day" else critical & (n >= most) for name, n, most in _before(tests)}
    return rows.select("*", F.coalesce(*[F.when(hit[name], name) for *_, name, _ in tests]).alias("reason"))


def _before(tests: list) -> Iterator[tuple[str, Column, int]]:
    """(name, rows before, most) of each test. Rows without a key have no limit, so each stands alone: were they one group, it
    would be one task's."""
    for key, span, most, name, own in tests:
        alone = F.when(F.col(key).isNull(), F.col("id"))
        w = W.partitionBy(F.col(key), alone).orderBy("at").rangeBetween(-span, 0)
        yield name, F.when(F.col(key).isNotNull(), F.sum(own).over(w) - own).otherwise(0), most


def daily_reason(rows: DataFrame) -> DataFrame:
    """``rows`` (id, at long in microseconds, fingerprint, ip) with ``reason``: the coarse limits of a day, over all rows stored
    in the day before; null if none was reached."""
    tests = [(k, DAY - 1, most, name, F.lit(1)) for k, _, most, name in STORED if name in ("fingerprint_day", "ip_day")]
    return rows.withColumn("reason", F.coalesce(*[F.when(n >= most, name) for name, n, most in _before(tests)]))


def _slide(events: list[int], now: int) -> tuple[bool, list[int]]:
    recent = [t for t in events if now - t < max(span for span, _ in SIGNALS)]
    if any(sum(now - t < span for t in recent) >= most for span, most in SIGNALS):
        return False, recent
    return True, [*recent, now]


def sliding(attempts: DataFrame) -> DataFrame:
    """``attempts`` (key, id, at long in milliseconds) with ``allowed``. A blocked attempt uses nothing up, so each depends on
    the ones before: a key's attempts are walked in order (at, id), with at most 30 remembered."""

    def begin():
        held: list[int] = []

        def step(at: int) -> bool:
            nonlocal held
            allowed, held = _slide(held, at)
            return allowed

        return step

    return walked(attempts, "key", [F.asc("at"), F.asc("id")], ["at"], begin, "allowed", "boolean")


def sliding_stream(attempts: DataFrame) -> DataFrame:
    """As ``sliding`` over a stream: decided at once, in the order of a batch, from one state of recent times for each key, which is kept.
    For attempts out of order, and for state that ends, see ``ordered.sliding_in_order``."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        whole = pd.concat(list(frames)).sort_values(["at", "id"])
        allowed = []
        for at in whole["at"].tolist():
            ok, held = _slide(held, at)
            allowed.append(ok)
        state.update((held,))
        yield whole.assign(allowed=allowed)

    return attempts.groupBy("key").applyInPandasWithState(step, f"{_ddl(attempts)}, allowed boolean", "held array<bigint>", "append", GroupStateTimeout.NoTimeout)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def bursts(submissions: DataFrame, late: str = "1 hour", most: int = 3) -> DataFrame:
    """Address blocks with critical submissions (ip, target, risk, at timestamp) against over ``most`` targets in seven days,
    by day; as a stream, with a watermark. Streams can't count distinct targets exactly, so they are collected as a set."""
    block = F.concat(F.substring_index("ip", ".", 3), F.lit(".0/24"))
    marked = submissions.where("risk = 'critical' and ip is not null")
    if submissions.isStreaming:
        marked = marked.withWatermark("at", late)
    counted = marked.groupBy(F.window("at", "7 days", "1 day").alias("w"), block.alias("block")).agg(F.size(F.collect_set("target")).alias("targets"), F.count(F.lit(1)).alias("submissions"))
    return counted.where(F.col("targets") > most).select("block", F.col("w.start").alias("since"), "targets", "submissions")


def tumbling(events: DataFrame, length: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of ``events`` (ts, event_type, value) by type and window."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("since"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a user's ``events`` (ts, user_id) without a pause of ``gap``."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def first_votes(votes: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One row of each key; over a stream within the watermark of ``ts``."""
    return votes.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if votes.isStreaming else votes.dropDuplicates(keys)
