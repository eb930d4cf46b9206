"""Choosing under a budget in an order where each choice depends on those before."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions import signals
from almanac.operators.walk import walked


def chunks(requests: DataFrame, most: int) -> DataFrame:
    """``requests`` (batch, pos, bytes) with ``chunk``: in order, a new one begins where the bytes would be over ``most``; what
    is larger by itself has its own."""

    def begin():
        number = used = 0

        def fill(size: int) -> int:
            nonlocal number, used
            if used and used + size > most:
                number, used = number + 1, 0
            used += size
            return number

        return fill

    return walked(requests.select("batch", "pos", "bytes"), "batch", [F.asc("pos")], ["bytes"], begin, "chunk", "int")


def documents(docs: DataFrame, most_bytes: int, most_pages: int) -> DataFrame:
    """``docs`` (place, pos, url, bytes, score) that are taken: by score, then pos; what doesn't fit is passed over, and smaller
    ones after it may still fit."""

    def begin():
        used = pages = 0

        def take(size: int) -> bool:
            nonlocal used, pages
            fits = pages < most_pages and used + size <= most_bytes
            used, pages = used + size * fits, pages + fits
            return fits

        return take

    return walked(docs, "place", [F.desc("score"), F.asc("pos")], ["bytes"], begin, "_taken", "boolean").where("_taken").drop("_taken")


def windows_of_text(pages: DataFrame, most: int, width: int = 1500) -> DataFrame:
    """``pages`` (id, text) with ``kept``: all of a short text; of a longer one its beginning and the parts of ``width``
    characters that tell most of offers, as far as they fit, in their order, gaps marked."""

    def cut(text: str) -> str:
        if len(text) <= most:
            return text
        parts = [text[i : i + width] for i in range(0, len(text), width)]
        scores = [len(re.findall(signals.MENU, p)) for p in parts]
        kept, used = [0], len(parts[0])
        for i in sorted(range(1, len(parts)), key=lambda i: -scores[i]):
            if scores[i] and used + len(parts[i]) <= most:
                kept.append(i)
                used += len(parts[i])
        kept.sort()
        return "".join((" … " if k and kept[k - 1] + 1 < i else "") + parts[i] for k, i in enumerate(kept))

    @F.pandas_udf("string")
    def chosen(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or ""))

    return pages.withColumn("kept", chosen("text"))


def snippet(pages: DataFrame, per_page: int, total: int) -> DataFrame:
    """(place, snippet): the texts of a place's ``pages`` (place, pos, url, text) in order, each cut to ``per_page`` characters and
    all to ``total``; null without any text. Running lengths are a window sum, so nothing is walked."""
    from pyspark.sql import Window as W

    n = F.least(F.length(F.trim("text")), F.lit(per_page))
    before = F.coalesce(F.sum(n).over(W.partitionBy("place").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("room", F.least(F.lit(per_page), total - before)).where("room > 0")
    part = F.concat(F.lit("Source: "), F.col("url"), F.lit("\n"), F.substr(F.trim("text"), F.lit(1), F.col("room")))
    return told.groupBy("place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "\n\n---\n\n").alias("snippet"))
