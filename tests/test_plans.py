"""Physical-plan properties the operators rely on at scale."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from shotweave.operators.sample import hash_topk, in_scope
from shotweave.sources.corpus import base_rows, corpus


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_is_partial_then_final_window_group_limit(spark):
    c = in_scope(corpus(spark, SF_SMALL)).where("split = 'train'")
    p = plan(hash_topk(c, 3))
    assert p.count("WindowGroupLimit") >= 2, p


def test_corpus_split_filter_prunes_partitions(spark):
    p = plan(corpus(spark, SF_SMALL).where(F.col("split") == "train"))
    assert "PartitionFilters: [isnotnull(split" in p and "(split" in p, p


def test_document_scan_reads_only_needed_columns(spark):
    p = plan(base_rows(spark, SF_SMALL))
    assert "n_chars" not in p.split("ReadSchema")[1].split("\n")[0], p


def test_no_cartesian_products_in_headline_queries(spark):
    q = E.queries()
    for name in ["flagship_upsample_fidelity", "fs04_leave_one_domain_out", "fs05_synthetic_quota",
                 "aug15_attr_grid", "mix01_mix_prompt", "res09_ttest", "met14_metric_dispatch"]:
        p = plan(q[name](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, (name, p)


def test_corpus_lines_stay_where_they_are_read(spark):
    """The classes are broadcast: building the corpus deals out no lines."""
    from shotweave.sources.corpus import build_corpus
    plan = build_corpus(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    join = plan.split("Join Inner")[1]
    assert "broadcast" in join.split("\n")[0]


def test_review_rows_relabel_once(spark, monkeypatch):
    """F9 to F11: the relabelled rows are written once, for the generator list and for the sheets."""
    from shotweave.operators import review
    written = []
    inner = review.durable
    monkeypatch.setattr(review, "durable", lambda df, name: written.append(name) or inner(df, name))
    f = spark.createDataFrame([("d", "d_a", "t", 1)], "domain string, intent string, text string, row_id long")
    rel = spark.createDataFrame([("upsample", "d_a", "x", "d_b", "k")], "attr string, old_intent string, text string, intent string, row_key string")
    out = review.review_rows(f, rel)
    assert written == ["relabelled"]
    assert sorted((r.kind, r.sheet, r.oracle_prediction) for r in out.collect()) == [("generated", "d<>d_a", "d_b"), ("prompt", "d<>d_a", None)]
