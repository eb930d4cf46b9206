"""The registry of chains goes to the names, not the names to the registry."""

from almanac.plans import catalogue


def test_the_registry_is_what_is_broadcast(spark):
    plan = catalogue.queries()["j18_chain_registry"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    built = plan.split("BroadcastExchange")[1:]
    assert built and all("FileScan" not in part and "Generate" not in part for part in built)
