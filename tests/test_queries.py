"""Every registered query against its SQL at the smallest scale."""

import compare
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


def test_sql_names_are_queries():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["class"] for r in rows} - {None} == {1, 2, 3, 4}


def plan_is_sound(df):
    """No crossed tables, and no window over a whole table in one task."""
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if "windowspecdefinition(" in line:
            spec = line.split("windowspecdefinition(", 1)[1]
            assert " ASC" not in spec.split(",")[0] and " DESC" not in spec.split(",")[0], line


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, spark, duck, sf):
    df = entry.queries()[name](spark, sf)
    plan_is_sound(df)
    assert compare.difference(df, duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_gives_rows(name, spark, sf):
    df = entry.queries()[name](spark, sf)
    plan_is_sound(df)
    assert df.count() > 0
