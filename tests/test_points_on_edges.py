"""Points on the edges of areas: each query by the bounds of its SQL."""

import pytest

from almanac.plans import catalogue
from tests.compare import duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edge_tables(spark, tmp_path_factory):
    """Customers whose points are on edges and corners, in every city."""
    folder = tmp_path_factory.mktemp("edges")
    spark.range(0, 500_000, 500).selectExpr("id as c_custkey", "'x' as c_name", "cast(floor(id / 20000) as int) as c_nationkey").write.parquet(f"{folder}/customer.parquet")
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(f"{folder}/nation.parquet")
    con = duck("/nowhere")
    for name in ("customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["g2_points_in_areas", "s12_boundary_probe", "s18_delete_outside", "g13_crossover", "a26_share_inside"])
def test_edges_against_sql(spark, edge_tables, name):
    folder, con = edge_tables
    assert spark_rows(catalogue.queries()[name](spark, folder)) == duck_rows(con, catalogue.oracles()[name])
