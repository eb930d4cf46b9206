"""Operators on whole tables: latest and best rows, upserts, differences between copies, trees, nested documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.session import cut


def equal(keys: list[str], a: str = "a", b: str = "b") -> Column:
    """Null-safe equality of columns of two aliases."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def best_per(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. Spark filters by rank before the shuffle too, so a large group costs ``n`` rows a task."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks, one of each key."""
    fresh = new.alias("a").join(old.alias("b"), equal(keys), "left_anti").dropDuplicates(keys)
    return old.unionByName(fresh.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], merge: dict[str, Column] | None = None) -> DataFrame:
    """``old`` updated by ``new``: new values win where there is a row, or what ``merge`` says of ``old`` and ``new`` columns. Null keys
    are equal; of rows of ``new`` with one key the greatest counts, column by column."""
    one = best_per(new, keys, *[F.desc_nulls_last(c) for c in new.columns]).withColumn("_new", F.lit(True))
    joined = old.alias("old").join(one.alias("new"), equal(keys, "old", "new"), "full_outer").withColumn("_new", F.coalesce("_new", F.lit(False)))
    pick = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")) if c in keys else (merge or {}).get(c, F.when(F.col("_new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")))
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def either(column: str) -> Column:
    """For ``upsert``: a flag that stays set."""
    return F.coalesce(F.col(f"old.{column}"), F.lit(False)) | F.coalesce(F.col(f"new.{column}"), F.lit(False))


def joined_set(column: str) -> Column:
    """For ``upsert``: the union of two arrays as sets, sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(F.col(f"old.{column}"), none), F.coalesce(F.col(f"new.{column}"), none)))


def update_from(target: DataFrame, source: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``target`` with ``column`` of its match in ``source`` where there is one, and ``changed``: whether that differs."""
    j = target.alias("a").join(source.select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_hit")).alias("b"), equal(keys), "left")
    differs = F.col("_hit").isNotNull() & ~F.col(f"a.{column}").eqNullSafe(F.col("_new"))
    return j.select(*[F.when(differs, F.col("_new")).otherwise(F.col(f"a.{c}")).alias(c) if c == column else F.col(f"a.{c}") for c in target.columns], differs.alias("changed"))


def three_way(stored: DataFrame, corrected: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with ``action``: "update" (in both, but inactive or with other ``values``), "deactivate" (active, no longer there),
    "insert" (new); rows that need nothing are left out. ``stored`` has a column active."""
    j = stored.alias("a").join(corrected.withColumn("_c", F.lit(True)).alias("b"), equal(keys), "full_outer")
    have, want = F.col("a.active").isNotNull(), F.col("_c").isNotNull()
    differs = ~F.col("a.active") | reduce(lambda x, y: x | y, [~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")) for v in values])
    action = F.when(have & want & differs, "update").when(have & ~want & F.col("a.active"), "deactivate").when(~have & want, "insert")
    return j.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], action.alias("action")).where("action is not null")


def new_by_either(new: DataFrame, old: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of ``new`` that ``old`` has by neither of two keys; null keys match nothing."""
    return new.join(old.select(first), first, "left_anti").join(old.where(F.col(second).isNotNull()).select(second), second, "left_anti").select(*new.columns)


def latest_of(*tables: DataFrame) -> DataFrame:
    """(id, at): the greatest time over tables of (id, at)."""
    return reduce(lambda a, b: a.unionByName(b), tables).groupBy("id").agg(F.max("at").alias("at"))


def changed_since(local: DataFrame, remote: DataFrame, cutoff: Column) -> DataFrame:
    """Ids whose local time is after the remote one and the cutoff; both sides must have them."""
    return local.alias("l").join(remote.alias("r"), "id").where((F.col("l.at") > F.col("r.at")) & (F.col("l.at") > cutoff)).select("id", F.col("l.at").alias("local_at"), F.col("r.at").alias("remote_at"))


def levels(tree: DataFrame, key: str, parent: str) -> DataFrame:
    """``key`` and its depth below a root (null or unknown parent); nodes of cycles, and below them, have none. A key that occurs at
    several levels counts at the first.

    By pointer doubling: each round a node looks twice as far up, through the nodes that it looked at before, so a chain of n nodes
    takes log2(n) rounds of two joins. A round in which no node finds a root leaves only cycles. Each round is cut.

    Rows without a parent are in no join, where they would be one key. Rows are dealt by key before they are made distinct, since
    keys hardly repeat, so no task holds all keys of its share of a file; and nothing is broadcast by the size of a file, which
    tells little of how many keys are in it."""
    width = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = tree.select(F.col(key).alias("k"), F.col(parent).alias("p")).where("k is not null")
    below, known = nodes.where("p is not null"), nodes.select(F.col("k").alias("p")).hint("merge")
    tied = below.join(known, "p", "left_semi").select("k", F.col("p").alias("up"))
    free = nodes.where("p is null").select("k").unionByName(below.join(known, "p", "left_anti").select("k"))
    marked = cut(tied.unionByName(free.withColumn("up", F.lit(None).cast(nodes.schema["p"].dataType))))
    done = cut(marked.where("up is null").select("k").repartition(width, "k").distinct().withColumn("depth", F.lit(0)))
    # ups: what stands ``far`` steps above k; whoever is less deep has none
    every, ups, far = done, cut(marked.where("up is not null").repartition(width, "k").distinct()), 1
    while not done.isEmpty():
        above = every.select(F.col("k").alias("up"), (F.col("depth") + far).cast("int").alias("depth"))
        left = ups.join(every.select("k").hint("merge"), "k", "left_anti")
        done = cut(left.join(above.hint("merge"), "up").groupBy("k").agg(F.min("depth").alias("depth")))
        over = ups.select(F.col("k").alias("up"), F.col("up").alias("over"))
        ups = cut(ups.join(over.hint("merge"), "up").select("k", F.col("over").alias("up")).distinct())
        every = every.unionByName(done)
        far *= 2
    return every.withColumnRenamed("k", key)


def nested(parents: DataFrame, key: str, **children: tuple[DataFrame, list[str]]) -> DataFrame:
    """``parents`` with one array of structs for each named child table (with ``key``): its columns, sorted by them in order.
    A parent without children has an empty array. Children are grouped before they are joined."""
    out = parents
    for name, (child, columns) in children.items():
        listed = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        kind = listed.schema[name].dataType
        out = out.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def audit_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str], actor: str, reason: str) -> DataFrame:
    """A row for each changed key: JSON of the row before and after."""
    j = before.alias("a").join(after.alias("b"), equal([key]))
    image = lambda t: F.to_json(F.struct(*[F.col(f"{t}.{c}").alias(c) for c in columns]), {"ignoreNullFields": "false"})
    same = F.struct(*[F.col(f"a.{c}") for c in columns]).eqNullSafe(F.struct(*[F.col(f"b.{c}") for c in columns]))
    return j.where(~same).select(F.col(f"a.{key}").alias(key), image("a").alias("before"), image("b").alias("after"), F.lit(actor).alias("actor"), F.lit(reason).alias("reason"))


def revert(current: DataFrame, audit: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """``current`` (with active, deleted_at) as it was before the changes in ``audit`` (key, before): fields of the image come
    back and the row lives; a row that had no image is deleted, and so inactive. Of several changes of a key the first by
    ``order`` counts; without it a key may occur once."""
    if order:
        audit = best_per(audit, [key], F.asc(order))
    kinds = ", ".join(f"{c} {current.schema[c].dataType.simpleString()}" for c in columns)
    j = current.alias("c").join(audit.select(F.col(key).alias("_k"), F.from_json("before", kinds).alias("_b"), F.col("before").isNull().alias("_gone")), F.col(f"c.{key}") == F.col("_k"), "left")
    hit, gone = F.col("_k").isNotNull(), F.coalesce(F.col("_gone"), F.lit(False))
    value = {c: F.when(hit & ~gone, F.col(f"_b.{c}")).otherwise(F.col(f"c.{c}")) for c in columns}
    value["active"] = F.when(gone, False).otherwise(value.get("active", F.col("c.active")))
    value["deleted_at"] = F.when(gone, F.coalesce("c.deleted_at", F.lit("reverted"))).when(hit, None).otherwise(F.col("c.deleted_at"))
    return j.select(*[value.get(c, F.col(f"c.{c}")).alias(c) for c in current.columns])


def state_at(current: DataFrame, audit: DataFrame, key: str, columns: list[str], at: Column) -> DataFrame:
    """(key, columns...) of every row that lived at the instant ``at``: a key's row is the before-image of its first change after it, or
    the row as it is now if there was none. ``audit`` has (key, at, before): JSON of the columns, null where the change made the
    row. A deleted row, which ``current`` lacks, comes back from its last image. Of changes at one time the least image counts,
    those that made the row first; a change at ``at`` itself has happened. Null keys are left out."""
    kinds = ", ".join(f"{c} {current.schema[c].dataType.simpleString()}" for c in columns)
    image = F.struct(F.col("at"), F.col("before").isNotNull().alias("told"), F.col("before"))
    first = audit.where(F.col(key).isNotNull() & (F.col("at") > at)).groupBy(F.col(key).alias("_k")).agg(F.min(image)["before"].alias("_before"))
    j = current.where(F.col(key).isNotNull()).select(F.col(key).alias("_own"), F.struct(*columns).alias("_now")).join(first.withColumn("_hit", F.lit(True)), F.col("_own") == F.col("_k"), "full_outer")
    row = F.when(F.col("_hit"), F.from_json("_before", kinds)).otherwise(F.col("_now"))
    lived = j.where(F.col("_hit").isNull() | F.col("_before").isNotNull())
    return lived.select(F.coalesce("_own", "_k").alias(key), row.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def mark_reverted(submissions: DataFrame, reverted: DataFrame, key: str, column: str = "status") -> DataFrame:
    """``submissions`` with ``column`` "reverted" where their ``key`` is among those of ``reverted`` and they had been applied."""
    hit = reverted.select(F.col(key).alias("_k")).where("_k is not null").distinct().withColumn("_hit", F.lit(True))
    j = submissions.join(hit, F.col(key) == F.col("_k"), "left")
    value = F.when(F.col("_hit") & (F.col(column) == "applied"), "reverted").otherwise(F.col(column))
    return j.select(*[value.alias(c) if c == column else F.col(f"`{c}`") for c in submissions.columns])


def soft_deleted(rows: DataFrame, why: Column, at: Column) -> DataFrame:
    """``rows`` (active, deleted_at and others) with those that live and for which ``why`` is told made inactive and deleted at ``at``; all
    others stay as they are, so a second run changes nothing."""
    gone = F.col("active") & F.col("deleted_at").isNull() & why.isNotNull()
    made = {"active": F.col("active") & ~gone, "deleted_at": F.when(gone, at).otherwise(F.col("deleted_at"))}
    return rows.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in rows.columns])
