"""Limits over streams in the order of event time, whose state ends.

An attempt waits in its key's state until the watermark has passed it; then it and all before it are decided in order, as a batch
job decides them, and a timer of the key removes what no later attempt can need. An attempt that comes after the watermark has
passed its time is late and is dropped, so it is neither decided nor counted. Needs the session's
``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider (``ROCKS``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from almanac.streaming.limits import SIGNALS, _slide

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LONGEST = max(span for span, _ in SIGNALS)


class Limiter(StatefulProcessor):
    """State of a key: attempts that wait (id, at), times that were allowed, and one timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id bigint, at bigint")
        self.held = handle.getListState("held", "at bigint")

    def _wake(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [pair for frame in rows for pair in zip(frame["id"].tolist(), frame["at"].tolist(), strict=True)]
        before = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.appendList([(int(i), int(at)) for i, at in new])
        self._wake(min(at for _, at in [*before, *new]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        due, later = sorted((at, i) for i, at in waiting if at < now), [(i, at) for i, at in waiting if at >= now]
        out = []
        for at, i in due:
            allowed, held = _slide(held, at)
            out.append((key[0], i, at, allowed))
        held = [t for t in held if now - t < LONGEST]  # whatever comes is not before the watermark
        self.waiting.clear(), self.held.clear()
        if later:
            self.waiting.put(later)
        if held:
            self.held.put([(t,) for t in held])
        if later or held:
            self._wake(min(at for _, at in later) if later else max(held) + LONGEST)
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "at", "allowed"])

    def close(self) -> None:
        pass


def sliding_in_order(attempts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of ``attempts`` (key string, id long, at long in milliseconds) as (key, id, at, allowed): what ``limits.sliding`` says
    of all attempts that are not late, whatever the order they come in, each once the watermark (``late`` behind the greatest
    time) has passed it. Rows with a null key, id or time are dropped. A key's state is its attempts within ``late`` and the last
    hour's allowed ones, 30 at most; it is removed an hour after the last of them."""
    timed = attempts.where("key is not null and id is not null and at is not null").select("key", "id", "at", F.timestamp_millis("at").alias("when")).withWatermark("when", late)
    return timed.groupBy("key").transformWithStateInPandas(Limiter(), "key string, id long, at long, allowed boolean", "append", "EventTime")


def concurrent_targets(submissions: DataFrame, span: str = "7 days") -> DataFrame:
    """``submissions`` (block, target, at timestamp and others) with ``targets``: the distinct targets of the block within ``span`` before
    each and at it, exactly.

    A target counts from each of its times until ``span`` later; where its times are closer, the stretches run into each other.
    So the ends of its stretches are +1 and -1, and the running sum along the block's time is the count at every moment. No
    set is held, and a target that comes often is two events. One shuffle by block; rows of a null block, target or time have null."""
    from pyspark.sql import Window as W

    long = F.expr(f"interval {span}")
    told = submissions.where("block is not null and target is not null and at is not null")
    own = W.partitionBy("block", "target").orderBy("at")
    placed = told.repartition("block").withColumn("before", F.lag("at").over(own)).withColumn("after", F.lead("at").over(own))
    starts = F.col("before").isNull() | (F.col("before") + long < F.col("at"))
    ends = F.col("after").isNull() | (F.col("at") + long < F.col("after"))
    mark = lambda at, change, row: F.struct(at.alias("moment"), change.cast("int").alias("change"), row.alias("row"))
    rows = F.struct(*[F.col(f"`{c}`") for c in submissions.columns])
    none = F.lit(None).cast(submissions.select(F.struct(*[F.col(f"`{c}`") for c in submissions.columns]).alias("r")).schema["r"].dataType)
    events = F.array(mark(F.col("at"), F.when(starts, 1).otherwise(0), rows), F.when(ends, mark(F.col("at") + long, F.lit(-1), none)))
    moments = placed.select(F.col("block").alias("of"), F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("of", "e.*")
    # up to a moment, all that starts by it counts, and what ends before it doesn't: ends come after the rows of their moment
    order = W.partitionBy("of").orderBy("moment", F.col("change") < 0).rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = moments.withColumn("targets", F.sum("change").over(order)).where("row is not null").select("row.*", "targets")
    return counted.unionByName(submissions.where("block is null or target is null or at is null").withColumn("targets", F.lit(None).cast("long")))


def sudden(submissions: DataFrame, most: int = 3, span: str = "7 days") -> DataFrame:
    """(block, since, until, targets) of every stretch in which an address block's critical submissions (ip, target, risk, at) were against
    over ``most`` targets within ``span``, by their own times and not by days: from the submission that crossed it to the last that was
    over it, with the most targets at once."""
    from pyspark.sql import Window as W

    block = F.concat(F.substring_index("ip", ".", 3), F.lit(".0/24"))
    marked = submissions.where("risk = 'critical' and ip is not null and target is not null and at is not null").select(block.alias("block"), "target", "at")
    counted = concurrent_targets(marked, span)
    run = W.partitionBy("block").orderBy("at")
    over = counted.groupBy("block", "at").agg(F.max("targets").alias("targets")).withColumn("over", F.col("targets") > most)
    new = over.withColumn("new", (F.col("over") & ~F.coalesce(F.lag("over").over(run), F.lit(False))).cast("int"))
    numbered = new.withColumn("stretch", F.sum("new").over(run.rowsBetween(W.unboundedPreceding, 0))).where("over")
    return numbered.groupBy("block", "stretch").agg(F.min("at").alias("since"), F.max("at").alias("until"), F.max("targets").alias("targets")).drop("stretch")
