"""Components of small edge lists: no shuffled joins."""

import pytest

from shotweave.llm import common, graph
from shotweave.llm.common import durable


@pytest.mark.parametrize("limit, join", [(100_000, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_components_of_few_nodes_join_by_broadcast(spark, monkeypatch, limit, join):
    plans = []

    def noted(df, name):
        if name == "labels":
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return durable(df, name)

    monkeypatch.setattr(graph, "durable", noted)
    monkeypatch.setattr(graph, "FEW_ROWS", limit)
    monkeypatch.setattr(common, "FEW_ROWS", limit)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        chain = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21)], "a long, b long")
        label = graph.components(chain)
        assert all(join in p for p in plans[1:])
        more = graph.joined(label, spark.createDataFrame([(9, 21), (30, 31)], "a long, b long"))
        assert join in plans[-1]
        got = {r.node: r.label for r in more.collect()}
    finally:
        spark.conf.set(key, before)
    assert {r.node: r.label for r in label.collect()} == {i: 1 for i in range(1, 10)} | {20: 20, 21: 20}
    assert got == {i: 1 for i in range(1, 10)} | {20: 1, 21: 1, 30: 30, 31: 30}
