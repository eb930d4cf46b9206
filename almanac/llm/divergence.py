"""Source divergence audit: which sources of a language differ, and by which terms.

Pairs of sources. A value is a sum over all kept terms of a language, of which most occur in few sources. So it is built from a
baseline, what every term would add if it occurred in neither, and corrections: for terms of one source as if the other had none
(from a count of terms by their count), and for terms of both, what these two miss (from the sources of each term).

Terms of a source. The k highest values of each group come from a radix select: a histogram of the values' highest bits over all
tasks tells in which bin the k-th stands, the next bits are counted inside it, and so on to the exact threshold. Of terms at the
threshold the smallest are found by the same counts over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.llm.common import bounded, cut, pieces, written

#: Terms and counts that a task holds; bits of a digit; bytes of a digit of tied terms; tied rows that are simply sorted.
HELD, BITS, BYTES, FEW = 400_000, 11, 2, 64
#: Bytes that end a term become a space, A-Z its lower case.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counting(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs) of a task's documents, added up as long as memory allows; a null term counts documents."""
        from collections import Counter

        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for part in pieces(batch, "text"):
                for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    key = (lang or "", source or "")
                    if key not in groups:
                        groups[key] = (Counter({None: 0}), Counter())
                    n, docs = groups[key]
                    before = len(n)
                    terms = (text or b"").translate(_TERM).split()
                    n.update(terms)
                    docs.update(set(terms))
                    docs[None] += 1
                    size += len(n) - before
                    if size > held:
                        yield from flush()
                        size = 0
        yield from flush()

    return run


def counted(docs: DataFrame, least: int = 10, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, total) of ``docs`` (text, lang, source): occurrences in the group and in its language of each term in at
    least ``least`` of the language's documents; and a row of null term for every group. Written once.

    Tasks add up what they can before anything moves, and one shuffle by (lang, term) serves both sums."""
    raw = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]).mapInArrow(_counting(held), "lang string, source string, term string, n long, docs long")
    each = raw.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = W.partitionBy("lang", "term")
    wide = each.select("lang", "source", "term", "n", F.sum("n").over(same).alias("total"), F.sum("docs").over(same).alias("df"))
    return written(wide.where(F.col("term").isNull() | (F.col("df") >= least)).drop("df"), "terms")


def share(n: Column, base: Column) -> Column:
    """1 + floor(10^9 * (n + 2) / base) in longs, exact for n below 9 * 10^13 and base below 9 * 10^14: long division in two steps."""
    x = (n + 2) * 100_000
    return F.lit(1) + _div(x, base) * 10_000 + _div(x % base * 10_000, base)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return _div((p - q) * (p - q), p + q)


def groups(terms: DataFrame) -> DataFrame:
    """(lang, source, g, v, base, none, lang_base) of every group: its number in the language, the language's kept terms, N + 2 V of the
    group and of the language, and the share of a term that doesn't occur (null without kept terms)."""
    kept = terms.where("term is not null").groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_n"))
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    found = own.join(kept, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long"))).withColumn("base", F.col("n") + 2 * F.col("v")).withColumn("lang_base", F.coalesce("lang_n", F.lit(0)) + 2 * F.col("v"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("source"))
    return found.select("lang", "source", number.alias("g"), "v", "base", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("base"))).alias("none"), "lang_base")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, term): for every two groups that share a term what their lone corrections miss, added up by pair."""
    most, held = 1 << 20, {}

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    def add(lang, g, p, none, start, size):
        """Rows a term's size apart meet: distance d pairs each row with the d-th after it, while that is of the same term."""
        left = start + size - np.arange(len(g)) - 1  # rows of the same term after each
        d = 1
        live = np.flatnonzero(left >= 1)
        while len(live):
            i, j = live, live + d
            value = f(p[i], p[j]) - f(p[i], none[j]) - f(none[i], p[j]) + f(none[i], none[j])
            code = (lang[i].astype(np.int64) << 42) | (np.minimum(g[i], g[j]).astype(np.int64) << 21) | np.maximum(g[i], g[j])
            keys, at = np.unique(code, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, value)
            for k, s in zip(keys.tolist(), sums.tolist(), strict=True):
                held[k] = held.get(k, 0) + s
            d += 1
            live = live[left[live] >= d]

    names: dict[str, int] = {}

    def flush():
        by = list(names)
        out = [(by[k >> 42], k >> 21 & 0x1FFFFF, k & 0x1FFFFF, v) for k, v in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), *(pa.array([r[i] for r in out], pa.int64()) for i in (1, 2, 3))], ["lang", "a", "b", "value"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lot = pa.concat_batches([rest, batch]) if rest is not None else batch
        own = lot.column("lang").to_pylist()
        lang = np.array([names.setdefault(x, len(names)) for x in own])
        term = lot.column("term").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])])
        first = np.flatnonzero(new)
        end = int(first[-1])  # the last term may go on in the next batch
        rest = lot.slice(end)
        if end:
            size = np.diff(first)
            start = np.repeat(first[:-1], size)
            g, p, none = (lot.column(c).slice(0, end).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "p", "none"))
            add(lang[:end], g, p, none, start, np.repeat(size, size))
        if len(held) > most:
            yield flush()
    if rest is not None:
        n = rest.num_rows
        g, p, none = (rest.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "p", "none"))
        add(np.full(n, names[rest.column("lang")[0].as_py()]), g, p, none, np.zeros(n, np.int64), np.full(n, n))
    if held:
        yield flush()


def pairs(shares: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language. ``shares``: (lang, term, g, n, p, none) of every group's
    terms; ``known``: see ``groups``."""
    one = known.select("lang", F.col("g").alias("a"), F.col("source").alias("a_source"), "v", F.col("none").alias("a_none"))
    two = known.select("lang", F.col("g").alias("b"), F.col("source").alias("b_source"), F.col("none").alias("b_none"))
    both = one.join(two, "lang").where("a < b")
    baseline = both.select("lang", "a", "b", F.coalesce(F.col("v") * apart(F.col("a_none"), F.col("b_none")), F.lit(0)).alias("value"))
    alike = shares.groupBy("lang", "g", "p", "none").agg(F.count(F.lit(1)).alias("terms"))
    lone = alike.join(two, "lang").where("g <> b").select("lang", F.least("g", "b").alias("a"), F.greatest("g", "b").alias("b"), (F.col("terms") * (apart(F.col("p"), F.col("b_none")) - apart(F.col("none"), F.col("b_none")))).alias("value"))
    shared = shares.select("lang", "term", "g", "p", "none").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_met, "lang string, a long, b long, value long")
    summed = baseline.unionByName(lone).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = summed.join(both.select("lang", "a", "b", "a_source", "b_source"), ["lang", "a", "b"])
    ways = F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))
    return named.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", "way.item", "value")


def select_top(df: DataFrame, keys: list[str], value: str, item: str, k: int, bits: int = BITS, few: int = FEW) -> DataFrame:
    """Rows of ``df`` among which are the ``k`` highest ``value`` (long, not negative) of each group of ``keys``, ties to the smallest
    ``item`` by UTF-8 bytes: fewer than ``k`` above the threshold, and at it those that are needed and at most ``few`` more, if items
    are distinct inside a group (equal ones all stay). ``df`` is read once for each digit, so it should be written; what a pass
    returns is a row for each group and bin."""
    top = df.agg(F.max(value)).first()[0] or 0
    shift = max(0, -(-int(top).bit_length() // bits) - 1) * bits
    state = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"), "n")
    while shift >= 0:
        bin_ = F.shiftright(F.col(value), shift)
        state = bounded(state)
        inside = df.join(state.select(*keys, "prefix"), keys).where(F.shiftright(bin_, bits) == F.col("prefix"))
        counts = inside.groupBy(*keys, bin_.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        state = _narrowed(counts, state, keys, "prefix", F.desc("prefix"))
        shift -= bits
    state = state.withColumnRenamed("prefix", "threshold").withColumn("prefix", F.lit(""))
    digit, done = F.hex(F.encode(item, "UTF-8")), 0
    longest = df.agg(F.max(F.length(digit))).first()[0] or 0
    while True:
        state = bounded(state)
        if done >= longest or state.where((F.col("n") > F.col("need")) & (F.col("n") > few)).isEmpty():
            break
        done += 2 * BYTES
        open_ = state.where((F.col("n") > F.col("need")) & (F.col("n") > few))
        inside = df.join(open_.select(*keys, "threshold", "prefix"), keys).where((F.col(value) == F.col("threshold")) & digit.startswith(F.col("prefix")))
        counts = inside.groupBy(*keys, F.substring(digit, 1, done).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        state = _narrowed(counts, open_, keys, "prefix", F.asc("prefix")).join(open_.select(*keys, "threshold"), keys).unionByName(state.where((F.col("n") <= F.col("need")) | (F.col("n") <= few)).select(*keys, "prefix", "need", "n", "threshold"))
    tied = (F.col(value) == F.col("threshold")) & (F.substring(digit, F.lit(1), F.length("prefix")) <= F.col("prefix"))
    return df.join(state.select(*keys, "threshold", "prefix"), keys).where((F.col(value) > F.col("threshold")) | tied).drop("threshold", "prefix")


def _narrowed(counts: DataFrame, state: DataFrame, keys: list[str], bin_: str, order: Column) -> DataFrame:
    """The bin of each group in which the last needed row stands (the last bin, if there are fewer), how many are needed of it, and its
    rows. ``counts`` has a row for each group and bin that occurs, at most 2 ** BITS (256 ** BYTES) for a group."""
    run = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = F.sum("n").over(run) - F.col("n")
    reached = counts.withColumn("before", before).join(state.select(*keys, "need"), keys).where(F.col("before") < F.col("need"))
    last = F.max(F.struct("before", bin_, "n", "need"))  # every bin has rows, so "before" grows with the order
    return reached.groupBy(*keys).agg(last.alias("l")).select(*keys, F.col(f"l.{bin_}").alias(bin_), (F.col("l.need") - F.col("l.before")).alias("need"), F.col("l.n").alias("n"))


def audit(docs: DataFrame, least: int = 10, k: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source; nulls as "", others are ignored).

    "pair": for every group (lang, source) each other source of the language by divergence over all kept terms, all ranks.
    "term": for every group the ``k`` terms that it has in a larger share than the language, by divergence. Ranks from 1, values
    descending, items by UTF-8 bytes. Repeated documents count as often as they occur; a group without terms has pairs, with its
    shares as if all counts were zero; a language of one source has none. An empty table gives no rows. Exact in longs while a
    group has fewer than 9 * 10^13 kept occurrences; beyond, arithmetic errors are raised and nothing wraps."""
    terms = counted(docs, least)
    known = bounded(groups(terms))
    shares = terms.where("term is not null").join(known, ["lang", "source"]).select("lang", "source", "term", "g", "n", share(F.col("n"), F.col("base")).alias("p"), "none", share(F.col("total"), F.col("lang_base")).alias("q"))
    shares = written(shares, "shares")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    one = pairs(shares, known).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    risen = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    best = select_top(written(risen, "risen"), ["lang", "source"], "value", "item", k)
    two = best.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    return one.unionByName(two).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
