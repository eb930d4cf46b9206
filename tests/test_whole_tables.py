"""Queries that read every row of their table."""

from almanac.plans import catalogue

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_votes_outside_of_the_subsets_are_judged(spark, tmp_path):
    import datetime

    rows = [(k, datetime.datetime(2024, 1, 1), k, kind, 1.0, "{}") for k, kind in ((7, "purchase"), (11, "click"), (13, "error"))]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: {r.target: r for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert {k: r.action for k, r in run("c28_evidence_files_whole").items()} == {7: "keep", 11: "delete", 13: "delete"}
    assert {k: r.decision for k, r in run("c18_flag_decision_whole").items()} == dict.fromkeys((7, 11, 13), "expired")
