"""The listing of places: documents with their windows, filtered, sorted and looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.functions import names


def matching(places: DataFrame, search: str | None = None, areas=(), types=(), tags=(), days=(), now: bool = False) -> DataFrame:
    """``places`` (name, area, type, tags, labels, windows array<struct<days, ...>>, live) that meet every criterion given: the
    text in the name or a label, an area and type of the lists, any of the tags, a window on any of the days, and live now.
    What is not given is no criterion; a place without windows meets none about days."""
    tests: list[Column] = []
    if search:
        wanted = search.lower()
        tests.append(F.lower("name").contains(wanted) | F.exists("labels", lambda x: F.lower(x).contains(wanted)))
    if areas:
        tests.append(F.col("area").isin(*areas))
    if types:
        tests.append(F.col("type").isin(*types))
    if tags:
        tests.append(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if days:
        tests.append(F.exists("windows", lambda w: F.arrays_overlap(w["days"], F.array(*map(F.lit, days)))))
    if now:
        tests.append(F.col("live"))
    for test in tests:
        places = places.where(F.coalesce(test, F.lit(False)))
    return places


def order(key: str) -> list[Column]:
    """The columns to sort places (name, area, type, first_start, last_end, level, least_cents, distance, live, today, promoted)
    by; what is missing comes last, ties go by name. Promoted places are first in the order of relevance only."""
    missing_last = lambda c: F.asc_nulls_last(c)
    level = F.coalesce("level", F.when(F.col("least_cents").isNotNull(), F.least(F.lit(4), F.ceil(F.col("least_cents") / 700)).cast("int")), F.lit(99))
    by = {
        "now": [~F.col("promoted"), F.when(F.col("live"), 0).when(F.col("today"), 1).otherwise(2), missing_last("first_start")],
        "distance": [missing_last("distance")],
        "startTime": [missing_last("first_start")],
        "endTime": [missing_last("last_end")],
        "name": [],
        "neighborhood": [missing_last("area")],
        "type": [names.type_label(F.col("type"))],
        "price": [level],
    }
    return [*by[key], F.asc("name")]


def ranked(places: DataFrame, key: str) -> DataFrame:
    """``places`` with their position, counted inside each city, so that no one task sorts all."""
    return places.withColumn("position", F.row_number().over(W.partitionBy("city").orderBy(*order(key))))
