"""Miles as C's printf writes them."""

from pyspark.sql import functions as F

from almanac.functions import geo


def test_halves_and_near_halves_of_a_tenth(spark):
    miles = [n / 20 for n in range(2, 201)] + [n / 400 for n in range(40, 4200)] + [2.5, 10.5, 11.5, 0.95, 9.95, 9.949999999999999, 9.96, 1.15, 6.05, 1.65, 0.3, 0.30000000000000004, 12345.5]
    got = spark.createDataFrame([(m,) for m in miles], "m double").select("m", geo.format_distance(F.col("m")).alias("t")).collect()
    assert [(r.m, r.t) for r in got if r.t != ("%.1f mi" if r.m < 10 else "%.0f mi") % r.m] == []
