"""Texts that are told in batches: once each, in pieces bounded by bytes."""

import re

from pyspark.sql import functions as F

from almanac.operators import text_windows, told

ROWS = [(1, "Mon-Fri 4pm-6pm happy hour"), (2, None), (3, ""), (4, "x " * 50_000 + "Sat, Sun open until 9pm"), (5, "weekends 10-2")]


def python_steps(df):
    return len(re.findall(r"ArrowEvalPython|MapInArrow|MapInPandas|BatchEvalPython", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]))


def test_texts_are_read_once(spark):
    df = spark.createDataFrame(ROWS, "id int, text string")
    assert python_steps(told.read(df).select("id", F.inline("times"))) == 1
    assert python_steps(told.read(df).select("id", F.explode("days"))) == 1
    assert python_steps(text_windows.parse(df).select("id", F.inline("windows"))) == 1


def test_pieces_of_any_size_tell_the_same(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "id int, text string").coalesce(1)
    got = lambda: ([r.asDict(True) for r in told.read(df).orderBy("id").collect()], [r.asDict(True) for r in text_windows.parse(df).orderBy("id").collect()])
    whole = got()
    assert [len(r["times"]) for r in whole[0]] == [1, 0, 0, 1, 1] and whole[0][3]["days"] == [[6, 7]]
    assert [len(r["windows"]) for r in whole[1]][:3] == [1, 0, 0]
    monkeypatch.setattr(told, "PIECE", 1)
    assert got() == whole


def test_columns_and_kinds_of_what_is_told(spark):
    df = spark.createDataFrame([("a", 7, "4-6pm", 1)], "windows string, n int, Text string, told int")
    assert text_windows.parse(df, "Text").columns == ["windows", "n", "Text", "told"]
    assert told.read(df, "text").columns == ["windows", "n", "Text", "told", "days", "times"]
    assert told.read(df, "n").first()["times"] == []
