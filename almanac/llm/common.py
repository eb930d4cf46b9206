"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators.batches import fresh, pieces, widen  # noqa: F401
from almanac.session import checkpoint_folder, cut

#: Words are runs of anything but the ASCII white space of ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, of which later reads take only the columns they need. The
    folder's owner removes it, as with checkpoints."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Most rows of a table of small rows that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, computed once, with a broadcast hint if it is counted to have at most ``rows`` rows."""
    done = cut(df)
    return F.broadcast(done) if done.count() <= rows else done


#: A key is hot if over one in this many rows has it, so there are fewer hot keys than this.
HOT = 1000


def spread(many: DataFrame, one: DataFrame, keys: list[str], rows: str = "n") -> DataFrame:
    """The inner join of ``many`` with ``one``, which has a row for each key that occurs in ``many`` and in ``rows`` how often.

    Hot keys, fewer than ``HOT`` by their definition, are broadcast, so their rows stay where they are; the others are
    joined by a shuffle, in which no key has more than its share. A small ``one`` is broadcast whole. Null keys meet nothing."""
    one = cut(one)
    n, total = one.agg(F.count(F.lit(1)), F.sum(rows)).first()
    if n <= BROADCAST_ROWS:
        return many.join(F.broadcast(one.drop(rows)), keys)
    hot = F.broadcast(one.where(F.col(rows) * HOT > total).drop(rows))
    return many.join(hot, keys).unionByName(many.join(hot, keys, "left_anti").join(one.where(F.col(rows) * HOT <= total).drop(rows), keys))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ranged(df: DataFrame, keys: list[str], pid: str) -> DataFrame:
    """``df`` range-partitioned by ``keys`` with the number of its partition in ``pid``; rows with equal keys share one.

    The result is cut, so that the bounds, which Spark samples anew for every evaluation, hold for all that is read from it."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(width, *[F.asc_nulls_first(k) for k in keys]).withColumn(pid, F.spark_partition_id()))


# ---- rows of a wide table, picked by number where they lie


def numbered_table(df: DataFrame, name: str) -> tuple[DataFrame, str, str]:
    """``df`` written to the shared checkpoint folder with a number for each row, and a bucket column that follows from the
    number's upper bits, the task that wrote the row; and the names of both. A task writes one bucket, so rows don't move.

    The buckets are as many as the session's shuffle partitions. The table is dropped from the catalog at once, its files stay
    (their owner removes them, as with checkpoints)."""
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = fresh(df.columns, "row")
    spot = fresh([*df.columns, row], "spot")
    unique = f"{name}_{uuid.uuid4().hex}"
    wide = df.withColumn(row, F.monotonically_increasing_id()).withColumn(spot, _spot(spark, F.col(row), width))
    wide.write.format("parquet").option("path", f"{checkpoint_folder(spark)}/{unique}").bucketBy(width, spot).saveAsTable(unique)
    table = spark.table(unique)
    spark.sql(f"DROP TABLE {unique}")
    return table, row, spot


def _spot(spark: SparkSession, row: Column, width: int) -> Column:
    """A value that Spark deals to bucket (task of ``row``) mod ``width``: for each bucket the least long of that hash."""
    least = spark.range(40 * width).groupBy(F.pmod(F.hash("id"), F.lit(width)).alias("b")).agg(F.min("id").alias("v")).collect()
    of = {r.b: r.v for r in least}  # one number for each shuffle partition
    values = [of.get(i, i) for i in range(width)]
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.pmod(F.shiftright(row, 33), F.lit(width)).cast("int"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted row numbers as a bitmap (array<long>) for each task that wrote some."""
    held, of, where = [], None, None

    def made() -> pa.RecordBatch:
        at = np.concatenate(held) & ((1 << 33) - 1)
        bits = np.zeros((int(at[-1]) // 64 + 1) * 64, np.uint8)
        bits[at] = 1
        words = np.packbits(bits, bitorder="little").view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([where], pa.int64()), pa.array([of], pa.int64()), pa.array([words], pa.list_(pa.int64()))], ["at", "task", "words"])

    for batch in batches:
        if not batch.num_rows:
            continue
        spot, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "row"))
        task = row >> 33
        ends = np.flatnonzero(np.r_[task[1:] != task[:-1], True]) + 1
        for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            if of is not None and task[a] != of:
                yield made()
                held = []
            of, where = int(task[a]), int(spot[a])
            held.append(row[a:b])
    if held:
        yield made()


def picked(table: DataFrame, row: str, spot: str, rows: DataFrame) -> DataFrame:
    """The rows of ``numbered_table``'s ``table`` whose number is in ``rows`` (row). Only numbers move: those of a task that wrote the
    table become one bitmap, which meets the task's bucket; a bitmap has a bit for each row of a written file."""
    spark = table.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.select("row", _spot(spark, F.col("row"), width).alias("at")).repartition(width, "at").sortWithinPartitions("row")
    maps = sorted_.mapInArrow(_bitmaps, "at long, task long, words array<long>").hint("shuffle_hash")
    index = F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    word = F.get("words", F.shiftright(index, 6).cast("int"))
    own = (F.col(spot) == F.col("at")) & (F.shiftright(row, 33) - F.col("task") == 0) & (F.call_function("shiftrightunsigned", word, index.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return table.join(maps, own, "left_semi")
