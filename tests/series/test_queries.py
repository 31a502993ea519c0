"""Every query with SQL gives the same rows as the SQL; the others keep their shape."""

import pytest
from conftest import DATA, rows

from seriesforge import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert rows(df) == oracle(catalog.ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"forest_pf2018"}))
def test_without_sql(spark, name):
    once = rows(catalog.QUERIES[name](spark, DATA))
    assert once
    if name in ("noise", "pad_suffix_noise", "pad_both_noise"):
        assert once == rows(catalog.QUERIES[name](spark, DATA))


def test_pruned_search_equals_brute_force(spark):
    from seriesforge.operators import dataset as D, neighbours as N

    s = D.embedding_series(spark, DATA).where("series_id < 120")
    full = N.nearest(s, s, "dtw", [{"window": 3}], exclude_self=True)
    assert rows(full) == rows(N.nearest_pruned(s, s, 3, exclude_self=True))
