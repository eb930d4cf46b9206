from pyspark.sql import functions as F

from almanac.llm import common


def test_rows_are_picked_where_they_lie(spark):
    n = 4000
    docs = spark.range(n).repartition(7).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(1).alias("row"), F.lit(2).alias("spot"))
    table, row, spot = common.numbered_table(docs, "rows")
    numbers = {r["doc_id"]: r[row] for r in table.collect()}
    assert len(numbers) == len(set(numbers.values())) == n and (row, spot) == ("row_", "spot_")
    wanted = [numbers[i] for i in range(0, n, 3)] + [(99 << 33) + 5, 3999]  # and numbers that no row has
    asked = spark.createDataFrame([(x,) for x in wanted], "row long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = common.picked(table, row, spot, asked)
        above = got._jdf.queryExecution().executedPlan().toString().split("FileScan")[0]
        assert "ShuffledHashJoin" in above and "Exchange" not in above and "Sort" not in above
        assert sorted((r.doc_id, r.text) for r in got.collect()) == [(i, f"text {i}") for i in range(0, n, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert common.picked(table, row, spot, asked.where("false")).count() == 0
