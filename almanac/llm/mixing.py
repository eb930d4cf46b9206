"""Mixing sources to target weights, in native expressions only.

Documents get hash-random keys; keys are range-sorted within each source; distributed prefix sums of token counts find the
row at which each source's exact budget ends; whole epochs repeat where a budget exceeds its source. Only ids, sizes and
keys are shuffled: the cut is one small row per source, which the documents are then held against in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.llm.common import WORD, bounded, cut, fresh, ranged, text_or_empty

#: Weights by rank of the source, repeating; all targets together as a fraction of all sizes; most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), (3, 2), 2


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash_key(doc_id: Column) -> Column:
    """60 bits of MD5: random to look at, the same in every run, and the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """From (source, source_size): source, source_size, target double, budget long.

    Sources by code point, nulls last, weigh ``weights`` in turn. Targets stop at ``epochs`` times the source's size; what is
    above is shared again by weight until none is above. The end of that is a water level, which is found without a loop: by
    rising ratio of cap to weight, the first source that the level of the rest doesn't drown sets it. The arithmetic is in
    whole numbers up to one division. The windows run over one row of some 60 bytes per source, in one task, so sources may be
    in the millions but not as many as documents."""
    num, den = share
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int")).cast("long")
    rising = W.orderBy(F.col("source_size") * 1.0 / F.col("weight"), F.asc_nulls_last("source"))
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s, w = F.col("source_size"), F.col("weight")
    left = num * F.col("total") - den * epochs * F.col("capped")  # den times the words that remain for this source and the rest
    return (
        sizes.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("rank", F.row_number().over(rising))
        .withColumn("capped", F.sum("source_size").over(rising.rowsBetween(W.unboundedPreceding, W.currentRow)) - s)
        .withColumn("open", F.sum("weight").over(whole) - F.sum("weight").over(rising.rowsBetween(W.unboundedPreceding, W.currentRow)) + w)
        .withColumn("level", F.when(left * w <= den * epochs * s * F.col("open"), F.struct("rank", left.alias("words"), F.col("open").alias("weight"))))
        .withColumn("level", F.min("level").over(whole))
        .withColumn("target", F.when(F.col("rank") < F.coalesce(F.col("level.rank"), F.col("rank") + 1), (epochs * s).cast("double")).otherwise((F.col("level.words") * w).cast("double") / (den * F.col("level.weight")).cast("double")))
        .select("source", "source_size", "target", F.floor("target").cast("long").alias("budget"))
    )


def cuts(keyed: DataFrame, goal: DataFrame) -> DataFrame:
    """One row per source of ``goal``: its columns, ``epochs`` and the row of ``keyed`` (source, key, doc_id, size) at which
    the last, partial epoch ends: ``cut`` struct<key, doc_id, size> and ``cut_words``, the words that rows equal to it give.

    Rows are range-sorted by (source, key, doc_id, size) over all partitions; a source's words in earlier partitions are
    summed from one row for each partition and source, and only then are running sums taken inside the partitions, so a
    source that holds most rows is spread like any other."""
    placed = ranged(keyed, ["source", "key", "doc_id", "size"], "pid")
    before = placed.groupBy("pid", "source").agg(F.sum("size").alias("here")).withColumn("prior", F.sum("here").over(W.partitionBy("source").orderBy("pid").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("here"))
    plan = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    starts = before.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.pid", "b.source", (F.col("rest") - F.col("prior")).alias("need"), "here").where("need > 0 and need <= here")
    running = W.partitionBy("pid", "source").orderBy(F.asc_nulls_first("key"), F.asc_nulls_first("doc_id"), F.asc_nulls_first("size"))
    equal = W.partitionBy("pid", "source", "key", "doc_id", "size")
    upto = placed.alias("r").join(starts.alias("s"), (F.col("r.pid") == F.col("s.pid")) & F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.need")
    ended = (
        upto.withColumn("upto", F.sum("size").over(running.rangeBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("first", F.col("upto") - F.col("size") * F.count(F.lit(1)).over(equal))
        .where("first < need and need <= upto")
        .groupBy("source")
        .agg(F.min(F.struct("key", "doc_id", "size")).alias("cut"), F.min(F.col("need") - F.col("first")).alias("cut_words"))
    )
    return plan.alias("p").join(ended.alias("e"), same(_of("p"), _of("e")), "left").select("p.*", "e.cut", "e.cut_words")


def _of(alias: str) -> dict:
    return {"source": F.col(f"{alias}.source")}


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with one struct column ``mix`` (longer if that clashes): size,
    source_size, target and taken, the words that the mix takes of the row, repeats counted.

    The last document of a source's budget is taken in part, so a source gives floor(target) words. Null texts have size 0
    and take 0; null ids and sources are values of their own, sources last. Rows that repeat (source, doc_id, size) fill
    the cut one after another, by the hash of their text. An empty table gives an empty one. The name of the new column is in ``mix_column``."""
    name = mix_column(docs)
    sized = cut(docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), hash_key(F.col("doc_id")).alias("key")))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    small = bounded(cuts(sized, goal)).alias("c")
    measured = lambda df: df.withColumn(name, F.struct(word_count(text_or_empty()).alias("size"), hash_key(F.col("doc_id")).alias("key")))
    same = F.col("l.source").eqNullSafe(F.col("c.source"))
    row = F.struct(F.col(f"l.{name}.key").alias("key"), F.col("l.doc_id").alias("doc_id"), F.col(f"l.{name}.size").alias("size"))
    joined = measured(docs).alias("l").join(small, same)
    # for the rows at a cut, words are counted again only where the key is that of a cut
    ending = measured(docs.withColumn(name, hash_key(F.col("doc_id"))).alias("l").join(small, same & (F.col(f"l.{name}") == F.col("c.cut.key")), "left_semi")).alias("l").join(small, same)
    out = lambda order: F.struct(
        F.col(f"l.{name}.size").alias("size"),
        F.col("c.source_size").alias("source_size"),
        F.col("c.target").alias("target"),
        (F.col("c.epochs") * F.col(f"l.{name}.size") + order).alias("taken"),
    )
    others = [F.col(f"l.`{c}`") for c in docs.columns]
    at_cut = F.coalesce(row.eqNullSafe(F.col("c.cut")), F.lit(False))
    whole = joined.where(~at_cut).select(*others, out(F.when(F.col("c.cut").isNotNull() & (row < F.col("c.cut")), F.col(f"l.{name}.size")).otherwise(0)).alias(name))
    nth = F.row_number().over(W.partitionBy(F.col("c.source")).orderBy(F.xxhash64("l.text"), F.length("l.text"))) - 1
    part = ending.where(at_cut).select(*others, out(F.greatest(F.lit(0), F.least(F.col(f"l.{name}.size"), F.col("c.cut_words") - nth * F.col(f"l.{name}.size")))).alias(name))
    return whole.unionByName(part)


def mix_column(docs: DataFrame) -> str:
    return fresh(docs.columns, "mix")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a row for each epoch of a document that is taken, the text of a
    source's last document cut after the words that the budget still has. Documents without words are not taken."""
    name = mix_column(docs)
    size, taken, nth = F.col(f"{name}.size"), F.col(f"{name}.taken"), fresh([*docs.columns, name], "epoch")
    copies = F.ceil(taken / F.greatest(size, F.lit(1))).cast("int")
    text = F.when(taken - F.col(nth) * size >= size, F.col("text")).otherwise(first_words(F.col("text"), taken - F.col(nth) * size))
    return (
        mix(docs, **how)
        .where(taken > 0)
        .withColumn(nth, F.explode(F.sequence(F.lit(0), copies - 1)))
        .select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    )
