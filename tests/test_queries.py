"""Every registered query of the library against its SQL, over the smallest tables."""

import pytest

from almanac.plans import catalogue
from tests.compare import duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_matches_sql(spark, con, name):
    assert spark_rows(catalogue.queries()[name](spark, SF)) == duck_rows(con, catalogue.oracles()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracles())))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.columns and df.count() > 0


def test_plain_reconciling_over_the_whole_tables(spark):
    from collections import defaultdict

    from almanac.plans import inputs
    from tests.test_windows import plain_reconcile

    places, hours = defaultdict(list), {r.place: r.periods for r in inputs.hours(spark, SF).collect()}
    for r in inputs.windows(spark, SF).where("active").collect():
        places[r.place].append(r.asDict())
    got = defaultdict(set)
    for r in catalogue.queries()["c6_reconcile"](spark, SF).collect():
        got[r.place].add((r.pos, tuple(r.days), r.active, tuple(r.reasons)))
    for place, rows in places.items():
        assert got[place] == plain_reconcile(rows, [tuple(p) for p in hours[place] or []]), place
    assert len(got) == len(places)
