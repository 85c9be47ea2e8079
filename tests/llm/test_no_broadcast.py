"""Joins of the near-duplicate operators are not left to Spark's guess of a table's size: nothing is broadcast."""

import pytest

from tilewright.llm import components, near, simhash
from tilewright.llm.common import materialize


@pytest.fixture
def plans(monkeypatch):
    """Texts of the plans of all tables that are written."""
    seen = []

    def noted(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The numbers of blocks of large clusters, one row for 64 sets at most, may be broadcast.
        seen.append(plan.replace("BroadcastExchange", "", 1) if name == "links" else plan)
        return materialize(df, name)

    for module in (components, near, simhash):
        monkeypatch.setattr(module, "materialize", noted)
    return seen


@pytest.mark.parametrize("limit", [simhash.BUCKET_LIMIT, 1])
def test_simhash_joins_are_merged(spark, make_docs, corpus, plans, limit):
    found = simhash.near_duplicates(make_docs(corpus), bucket_limit=limit)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == len(corpus) and not any("BroadcastExchange" in p for p in plans)
    assert any("SortMergeJoin" in p for p in plans)


def test_near_joins_are_merged(spark, make_docs, corpus, plans):
    found = near.drop_similar(make_docs(corpus))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() and not any("BroadcastExchange" in p for p in plans)
    assert any("SortMergeJoin" in p for p in plans)
