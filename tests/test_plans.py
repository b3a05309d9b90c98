"""Plan checks for scale: no cartesian products, Python only where intended,
filters and column pruning reach the parquet scan."""
import pytest

from eventide.registry import QUERIES
from eventide.plans.people import user_reservations
from tests.conftest import SF_SMALL

# Jobs whose semantics need per-key Python state (documented in their modules).
PYTHON_OK = {"admit_bookings", "match_groups", "otp_audit", "stream_otp_throttle", "stream_admit"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_cartesian_and_python_only_where_intended(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    if name not in PYTHON_OK:
        for node in ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas",
                     "MapInPandas", "PythonUDF"):
            assert node not in plan, node


def test_filter_and_pruning_reach_scan(spark, t_small):
    df = user_reservations(t_small, users=[5, 7], sort=False)
    df.explain("formatted")
    plan = _plan(df)
    assert "PushedFilters: [In(o_custkey" in plan or "o_custkey IN" in plan
    # orders scan reads only the columns the query needs
    scan = [ln for ln in plan.splitlines() if "orders.parquet" in ln or "ReadSchema" in ln]
    assert not any("o_orderpriority" in ln for ln in scan)


def test_admission_range_partitions_requests(spark, t_small):
    """ADM-1 must not hash one event into one task: its sorted input is range
    partitioned on (event, time, id) before the checkpoint."""
    from eventide.operators.folds import admit_bookings
    import io
    import contextlib
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        admit_bookings(t_small, t_small.booking_requests).explain("extended")
    # the checkpointed input shows up as an existing RDD; the range exchange is
    # in the plan that produced it, so check the operator source instead
    import inspect
    src = inspect.getsource(admit_bookings)
    assert 'repartitionByRange(P, "event_id", "requested_at", "request_id")' in src
    assert "checkpoint(eager=True)" in src
    assert "ExistingRDD" in buf.getvalue() or "LogicalRDD" in buf.getvalue()


def test_similar_events_ranks_keys_not_texts(t_small):
    """A window over a source's candidates sorts their keys alone."""
    from eventide.plans.catalog import similar_events
    todo, outputs = [similar_events(t_small, "1998-06-01 00:00:00")._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "Window":
            outputs.append({node.output().apply(i).name() for i in range(node.output().size())})
        todo += [node.children().apply(i) for i in range(node.children().size())]
    by_source = [names for names in outputs if "source_id" in names]
    assert by_source and not any(names & {"title", "slug", "thumbnail"} for names in by_source)
