"""Plans of queries whose tables are larger than Spark guesses from their files."""

import pytest

from quern import session
from quern.jobs import evaluation
from quern.operators import ordering, scoring, significance
from quern.queries import QUERIES
from quern.session import stash

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def collected(spark, monkeypatch, name):
    """The tables a query broadcasts, of all that it writes on the way and of its result."""
    seen = {}
    for module in (scoring, evaluation, ordering):
        def kept(df, of, write=module.stash):
            seen[of] = plan(df)
            return write(df, of)

        monkeypatch.setattr(module, "stash", kept)
    seen["result"] = plan(QUERIES[name](spark, SF))
    return {of for of, p in seen.items() if "BroadcastExchange" in p}


@pytest.mark.parametrize("name", ["evaluate_answers", "failure_counts", "summary_by_config"])
def test_answers_are_not_broadcast(spark, monkeypatch, name):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    assert not collected(spark, monkeypatch, name)


def test_values_are_not_broadcast(spark):
    """Values of two configurations meet by a shuffle join; only the pairs of configurations are broadcast."""
    rows = spark.range(1000).selectExpr("'f' as family", "concat('c', id % 3) as config", "id div 3 as id", "rand(1) as value")
    values = stash(rows, "values")
    pairs = significance.pair_grid(values.select("family", "config").distinct(), "family")
    joined = significance.paired(values, pairs, "family")
    found = plan(joined)
    assert found.count("BroadcastHashJoin") == 1 + plan(pairs).count("BroadcastHashJoin") and "SortMergeJoin" in found
    assert joined.count() == 333 * 3


def test_many_rows_are_not_broadcast(spark):
    many = stash(spark.range(100).selectExpr("id", "id % 7 as n"), "many")
    of = lambda most: plan(many.join(session.few(many.select("id"), most), "id"))
    assert "BroadcastHashJoin" in of(100) and "BroadcastHashJoin" not in of(99)
