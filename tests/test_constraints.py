"""DQ-1 on small tables with every kind of violation, and its plan."""
import re

import pytest

from eventide.operators.constraints import Rule, audit, marketplace_rules


def found(df):
    return {(r.table_name, r.rule, r.columns): (r.violations, r.sample_key) for r in df.collect()}


def test_every_kind_of_violation(spark):
    users = spark.createDataFrame(
        [(1, "a", "x|y", "z"), (2, "b", "x", "y|z"), (2, None, "x", "y|z"), (None, "c", None, "q"), (11, "a", None, "q")],
        "id long, name string, p string, q string")
    notes = spark.createDataFrame(
        [(1, 1, 2, "on", 3), (2, 7, 1, "off", 9), (3, 7, None, "?", 0), (4, 2, 8, None, None), (5, 10, 8, "?", 5)],
        "id int, user_id int, friend_id int, state string, score int")
    rules = [Rule("users", "pk", ("id",)), Rule("users", "unique", ("name",)), Rule("users", "unique", ("p", "q")),
             Rule("users", "not_null", ("name",)), Rule("users", "not_null", ("id",)),
             Rule("notes", "pk", ("id",)), Rule("notes", "unique", ("user_id", "friend_id")),
             Rule("notes", "fk", ("user_id",), ref=("users", "id")),
             Rule("notes", "fk", ("friend_id",), ref=("users", "id")),
             Rule("notes", "fk", ("id",), ref=("notes", "id")),
             Rule("notes", "enum", ("state",), values=("on", "off", "it's")),
             Rule("notes", "range", ("score",), values=(1, 5)),
             Rule("notes", "not_null", ("gone",)), Rule("notes", "fk", ("user_id",), ref=("nowhere", "id")),
             Rule("nowhere", "pk", ("id",))]
    got = found(audit({"users": users, "notes": notes}, rules))
    assert got == {
        ("users", "pk", "id"): (1, "2"), ("users", "unique", "name"): (1, "a"),
        ("users", "unique", "p,q"): (1, "x|y\\|z"), ("users", "not_null", "name"): (1, "2"),
        ("users", "not_null", "id"): (1, None), ("notes", "pk", "id"): (0, None),
        ("notes", "unique", "user_id,friend_id"): (0, None),
        ("notes", "fk", "user_id"): (None, None),  # the later rule of the same name: no such table
        ("notes", "fk", "friend_id"): (2, "8"), ("notes", "fk", "id"): (0, None),
        ("notes", "enum", "state"): (2, "3"), ("notes", "range", "score"): (2, "2"),
        ("notes", "not_null", "gone"): (None, None), ("nowhere", "pk", "id"): (None, None)}
    rows = audit({"users": users, "notes": notes}, rules[:8]).filter("rule = 'fk'").collect()
    assert [(r.violations, r.sample_key) for r in rows] == [(3, "10")]


def test_empty_tables_break_nothing_but_references(spark):
    users = spark.createDataFrame([], "id long, name string")
    notes = spark.createDataFrame([(1, 5)], "id long, user_id long")
    got = found(audit({"users": users, "notes": notes}, [
        Rule("users", "pk", ("id",)), Rule("users", "not_null", ("name",)),
        Rule("notes", "fk", ("user_id",), ref=("users", "id"))]))
    assert got == {("users", "pk", "id"): (0, None), ("users", "not_null", "name"): (0, None),
                   ("notes", "fk", "user_id"): (1, "5")}


def test_one_scan_a_table(spark, tmp_path):
    """All rules of a table share its one scan; no join but that with the list of rules."""
    rules = [r for r in marketplace_rules() if r.table in ("users", "events", "reservations", "messages")]
    tables = {}
    for t in ("users", "events", "reservations", "messages"):
        cols = sorted({c for r in rules if r.table == t for c in r.cols})
        schema = ", ".join(f"{c} {'long' if c == 'id' or c.endswith('_id') else 'string'}" for c in cols)
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / t))
        tables[t] = spark.read.parquet(str(tmp_path / t))
    plan = audit(tables, rules)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 4
    assert len(re.findall(r"Join", plan)) == 1 and "BroadcastHashJoin" in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 3


def test_many_references_to_one_table(spark):
    """More foreign keys than a space counts side by side: each its own count, in one shuffle of keys."""
    users = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    cols = [f"u{k}_id" for k in range(8)]
    # column k refers k times to a user that is missing, and to users that exist
    rows = [(i, *[9 if i < k else 1 + i % 2 for k in range(8)]) for i in range(10)]
    notes = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ["id", *cols]))
    rules = [Rule("users", "pk", ("id",)), Rule("notes", "pk", ("id",))]
    rules += [Rule("notes", "fk", (c,), ref=("users", "id")) for c in cols]
    df = audit({"users": users, "notes": notes}, rules)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(space", plan)) == 2  # by key, and by rule
    assert found(df) == {
        ("users", "pk", "id"): (1, "2"), ("notes", "pk", "id"): (0, None),
        **{("notes", "fk", c): (k, "9" if k else None) for k, c in enumerate(cols)}}


@pytest.mark.parametrize("kind, n", [("pk", 25), ("unique", 5), ("enum", 12), ("range", 1), ("fk", 53)])
def test_the_declared_rules(kind, n):
    assert sum(r.kind == kind for r in marketplace_rules()) == n
    assert sum(r.kind == "not_null" for r in marketplace_rules()) == 156
