"""Every registered query against its DuckDB oracle (columns, rows, values)."""
import pytest

from __spark_entry__ import entry, oracle_sql, queries as all_queries
from eventide.registry import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.helpers import duck, rows

NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    got_arrow = QUERIES[name](spark, SF_SMALL).toArrow()
    want_arrow = con.sql(ORACLES[name]).arrow()
    if hasattr(want_arrow, "read_all"):  # a RecordBatchReader in newer DuckDB
        want_arrow = want_arrow.read_all()
    # same column types at the Arrow level (int32 vs int64 would hash apart)
    types = lambda t: {f.name: str(f.type) for f in t.schema}
    assert types(got_arrow) == types(want_arrow)
    got, want = got_arrow.to_pandas(), want_arrow.to_pandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)


# Checked by properties / edge tests instead (see README).
NO_ORACLE: set = set()


def test_every_query_has_callable_and_oracle():
    assert set(QUERIES) - set(ORACLES) == NO_ORACLE
    assert set(QUERIES) <= set(all_queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "capacity_left" in df.columns


def test_catalog_filters_match_oracle(spark, con):
    """Q01 with every optional filter (FLT-3..8), Jalali day input included."""
    from eventide.plans.catalog import catalog_rank, event_catalog
    from eventide.registry import flat
    from eventide.sources.views import AS_OF, domain
    t = domain(spark, SF_SMALL)
    base = ORACLES["event_catalog"]
    cases = [
        (dict(location="econ"), "lower(e.location) LIKE '%econ%'"),
        (dict(day="1376/06/10"), "cast(e.start_time AS date) = DATE '1997-09-01'"),
        (dict(categories="1,3"), "e.category_id IN (1, 3)"),
        (dict(grouping=2), "e.grouping = 2"),
        (dict(grouping=25), "e.grouping > 25"),
        (dict(hours="8-12, bad, 20-23"),
         "((hour(e.start_time) >= 8 AND hour(e.start_time) < 12) OR "
         "(hour(e.start_time) >= 20 AND hour(e.start_time) < 23))"),
    ]
    for kw, cond in cases:
        got = flat(catalog_rank(event_catalog(t, AS_OF, sort=False, **kw))).toPandas()
        want = con.sql(base + " AND " + cond).df()
        assert rows(got) == rows(want), kw
    # leader mode: status test dropped, privacy kept
    got = flat(catalog_rank(event_catalog(t, AS_OF, leader_id=3, sort=False))).toPandas()
    want = con.sql(base.replace("WHERE e.status = 'verified' AND NOT e.is_private",
                                "WHERE NOT e.is_private AND e.leader_id = 3")).df()
    assert len(got) > 0 and rows(got) == rows(want)
