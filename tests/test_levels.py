"""What depths of trees cost: rows without a parent, and files that hold many more keys than their size tells."""

import re

from almanac.operators import tables
from almanac.session import cut


def test_levels_join_no_row_without_a_parent_and_broadcast_nothing(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(tables, "cut", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or cut(df))
    spark.range(30_000).selectExpr("id", "IF(id % 10 = 0, id - 1, NULL) AS parent").write.parquet(str(tmp_path / "tree"))
    got = tables.levels(spark.read.parquet(str(tmp_path / "tree")), "id", "parent")
    assert {r.depth: r["count"] for r in got.groupBy("depth").count().collect()} == {0: 27_001, 1: 2_999}
    assert not [p for p in plans if "Broadcast" in p]
    joins = [p for p in plans if re.search(r"\bid#|\bparent#", p) and "Join" in p]
    assert joins and not [p for p in joins if "LeftOuter" in p]


def test_levels_of_repeated_rows_with_and_without_parents(spark):
    rows = [(1, None), (1, None), (2, 1), (2, None), (3, 2), (3, 99), (4, 3), (4, 3), (5, 6), (6, 5), (7, 5), (None, 1), (8, 8)]
    got = tables.levels(spark.createDataFrame(rows, "k int, p int"), "k", "p").collect()
    assert sorted((r.k, r.depth) for r in got) == [(1, 0), (2, 0), (3, 0), (4, 1)]
