"""Offers are judged once each, and repeats are found by one list of keys."""

from pyspark.sql import functions as F

from almanac.operators import gates


def test_repeats_of_kept_offers_and_one_judgement_each(spark):
    names = ["Draft beer", "$5 draft beer", "Happy Hour", "draft  BEER", "happy hour", "Draft beer", None]
    offers = [(n, 500 if k != 5 else 600, None, "drink", "beer") for k, n in enumerate(names)]
    kind = "o array<struct<name: string, cents: int, description: string, kind: string, category: string>>"
    done = spark.createDataFrame([(offers,), ([],), (None,)], kind).select(gates.sanitised(F.col("o"), F.array(F.lit(1)), F.lit(2)).alias("s"))
    rows = done.collect()
    assert [o.verdict for o in rows[0].s] == ["keep", "duplicate", "heading", "duplicate", "heading", "keep", "keep"]
    assert rows[1].s == [] and rows[2].s is None
    assert done._jdf.queryExecution().analyzed().toString().count("regexp_replace") < 30
