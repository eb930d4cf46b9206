"""Quality rules with risk-controlled thresholds.

Each rule scores a document in per mille of its words or characters. Labelled documents are the holdout: in every stratum and
for every rule an exact binomial test bounds the share of good documents that a cutoff rejects, and only cutoffs that pass at
a confidence corrected for all strata and rules are used. Within what is allowed, the cutoff that separates best is taken."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.llm.common import bounded, fresh, widen

#: Fixed values of the contract: symbols, fewest words, most words in repeated windows (per cent).
SYMBOLS, FEWEST, MOST_REPEATED = "#*$%&|<>", 50, 50
SPACES = " \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))

STATS = "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, n_lines: long, n_upper: long>"

#: Rule -> per mille score, by the statistics; larger is worse. A denominator of 0 gives 0.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_upper", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_windows": ("n_repeat_words", "n_words"),
}


@dataclass(frozen=True)
class Risk:
    """At most ``share`` of a stratum's good documents (base passed, quality 1) may be rejected by all rules together, with
    probability 1 - ``delta`` over all strata and rules. ``weight``: rejecting one per cent of the good documents must buy
    over ``weight`` per cent of the bad ones."""

    share: float = 0.05
    delta: float = 0.05
    weight: int = 10


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    k = len(known)
    pair = ids[:-1] * k + ids[1:]
    if k > 1_600_000:  # the product of three would not fit
        _, pair = np.unique(pair, return_inverse=True)
    key = pair[:-1] * k + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return int(np.count_nonzero(np.r_[twice, False, False] | np.r_[False, twice, False] | np.r_[False, False, twice]))


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, UPPER)),
    )


def _measurer():
    names = [f.split(":")[0].strip() for f in STATS[7:-1].split(",")]
    return lambda texts: pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (zip(*map(measure, texts), strict=True) if texts else [[]] * len(names))], names)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < FEWEST) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


def scores(s: Column) -> Column:
    """array<struct<rule, score>>"""
    ratio = lambda a, b: F.when(s[b] > 0, F.floor(1000 * s[a] / s[b])).otherwise(0).cast("int")
    return F.array(*[F.struct(F.lit(rule).alias("rule"), ratio(a, b).alias("score")) for rule, (a, b) in RULES.items()])


def most_rejected(n: int, share: float, delta: float) -> int:
    """The largest k at which the exact upper bound (Clopper-Pearson, confidence 1 - ``delta``) of k rejections in ``n`` is at
    most ``share``; -1 if there is none. That is the largest k with P(Bin(n, share) <= k) <= delta."""
    total, term, k = 0.0, n * math.log1p(-share), -1
    while k < n:
        total += math.exp(term)
        if total > delta:
            return k
        k += 1
        term += math.log((n - k) / (k + 1)) + math.log(share) - math.log1p(-share) if k < n else 0
    return k


def thresholds(measured: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, rule, cutoff): a document is rejected if its score is above the cutoff; rows only where a cutoff is proven.

    ``measured``: doc_id, stratum, stats. ``labels``: doc_id, quality (null: no label; of several the least counts). Scores
    are counted in per mille bins before anything is gathered, so what meets in one place is at most a row for each stratum,
    rule and one of some thousand scores, whatever the number of documents; strata are languages or the like, not ids. Cutoffs between equally good ones are taken at the middle."""
    label = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.where(~base_failed(F.col("stats"))).join(label, "doc_id").select("stratum", "quality", F.inline(scores(F.col("stats"))).alias("rule", "score"))
    bins = held.groupBy("stratum", "rule", "score").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count(F.when(F.col("quality") == 0, 1)).alias("bad"))
    group, whole = W.partitionBy("stratum", "rule"), W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    falling = group.orderBy(F.desc("score"))
    upto = falling.rowsBetween(W.unboundedPreceding, W.currentRow)
    most = F.pandas_udf(lambda n, tests: pd.Series([most_rejected(int(a), risk.share / len(RULES), risk.delta / int(b)) for a, b in zip(n, tests, strict=True)], dtype="int64"), "long")
    tried = (
        bins.withColumn("n_good", F.sum("good").over(group))
        .withColumn("n_bad", F.sum("bad").over(group))
        .withColumn("k", F.sum("good").over(upto) - F.col("good"))
        .withColumn("j", F.sum("bad").over(upto) - F.col("bad"))
        .withColumn("above", F.lag("score").over(falling))
        .withColumn("tests", F.sum(F.when(F.col("above").isNull(), 1).otherwise(0)).over(whole))
    )
    allowed = (
        tried.where("above is not null")
        .withColumn("gain", F.col("j") * F.col("n_good") - risk.weight * F.col("k") * F.col("n_bad"))
        .where("gain > 0")
        .withColumn("most", most("n_good", "tests"))
        .where("k <= most")
    )
    best = allowed.withColumn("top", F.max("gain").over(group)).where("gain = top")
    return best.groupBy("stratum", "rule").agg(F.floor((F.min("score") + F.max("above") - 1) / 2).cast("int").alias("cutoff"))


def measured(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` (text and any others) with a struct column of its statistics, whose name is returned too."""
    name = fresh(docs.columns, "quality")
    return widen(docs, name, STATS, _measurer), name


def judge(wide: DataFrame, name: str, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang") -> DataFrame:
    """``wide`` (doc_id, ``stratum``, the statistics ``name``, and any others) with ``name`` extended by base_failed, kept and
    failed_rules, the names of the rules whose cutoff the document exceeds. ``wide`` is read twice: once for the thresholds,
    of which only statistics are shuffled, and once for the rows, which are held against one small row per stratum.

    Null texts count as empty and fail the base. Null ids match no label; a null stratum is one of its own. Repeated rows are
    judged alike. Strata with too few labels to prove a cutoff have none and lose nothing beyond the base."""
    found = thresholds(wide.select("doc_id", F.col(stratum).alias("stratum"), F.col(name).alias("stats")), labels, risk)
    cutoffs = bounded(found.groupBy(F.col("stratum").alias("judged_stratum")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "cutoff")))).alias("cutoffs")))
    limit = fresh(wide.columns, "cutoffs")
    key = fresh([*wide.columns, limit], "judged")
    joined = wide.join(cutoffs.select(F.col("judged_stratum").alias(key), F.col("cutoffs").alias(limit)), F.col(stratum).eqNullSafe(F.col(key)), "left")
    failed = F.transform(F.filter(scores(F.col(name)), lambda x: x["score"] > F.try_element_at(F.col(limit), x["rule"])), lambda x: x["rule"])
    verdict = F.when(F.col(limit).isNull(), F.array().cast("array<string>")).otherwise(failed)
    fields = [F.col(name)[f].alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    judged = F.struct(*fields, base_failed(F.col(name)).alias("base_failed"), (~base_failed(F.col(name)) & (F.size(verdict) == 0)).alias("kept"), verdict.alias("failed_rules"))
    return joined.select(*[judged.alias(c) if c == name else F.col(f"`{c}`") for c in wide.columns])


def quality_filter(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    wide, name = measured(docs)
    return judge(wide, name, labels, risk, stratum).where(F.col(name)["kept"]).drop(name)
