"""Completions are parsed and scored once, however their columns are used afterwards."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shotweave.functions.rand import stream, stream_lists
from shotweave.operators import mix as X
from shotweave.plans import catalog  # noqa: F401  (registers the query groups in order)
from shotweave.plans import q_mix


def test_votes_evaluate_tokens_once(spark):
    plan = q_mix._votes(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    assert plan.count("array_position(") <= 2 and plan.count(" RLIKE ") <= 2  # one CASE for each of two columns


def test_computed_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, " a. (intent: B)"), (2, None), (3, "none")], "id int, text string")
    t, lbl = X.parse_pair(F.col("text"))
    got = X.computed(df, t=t, lbl=lbl).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, " a. (intent: B)", "a.", "b"), (2, None, None, None), (3, "none", None, None)]


@pytest.mark.parametrize("parts", (1, 3))
def test_stream_lists_are_the_streams(spark, parts):
    rows = [(i, (i * 7919) % 268435456, (i * 104729) % 268435456, n) for i, n in enumerate((0, 1, 5, 200, 0, 3))]
    df = spark.createDataFrame(rows, "i int, s1 long, s2 long, n int").repartition(parts)
    got = {r.i: r.u for r in df.select("i", stream_lists(F.col("s1"), F.col("s2"), F.col("n")).alias("u")).collect()}
    assert got == {i: stream((s1, s2), 0, n).tolist() for i, s1, s2, n in rows}
