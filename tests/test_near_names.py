"""Near names of many and of equal customers."""

from pyspark.sql import functions as F

from almanac.operators import spatial
from almanac.plans import catalogue
from tests.compare import duck, duck_rows, spark_rows


def test_forms_are_never_broadcast(spark):
    keys = spark.range(50).select(F.lit(1).alias("city"), F.concat(F.lit("Customer"), F.col("id").cast("string")).alias("key"))
    plan = spatial.near_keys(keys, ["city"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_repeated_and_short_names_against_sql(spark, tmp_path):
    rows = [(k, name, k % 2) for k, name in enumerate(["anna 1", "anna 1", "anna 2", "anna 2", "anna 2", "x", "y", "x", "y", "anna 12", None, ""])]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    con = duck("/nowhere")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    name = "f6_near_names"
    assert spark_rows(catalogue.queries()[name](spark, str(tmp_path))) == duck_rows(con, catalogue.oracles()[name])
