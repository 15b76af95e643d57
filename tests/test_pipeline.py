"""Invariants of sampling, augmentation, assembly and the stream."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shotweave.operators import augment as A
from shotweave.operators import sample as S
from shotweave.operators.assemble import assemble, get_split
from shotweave.operators.mix import normalise_votes, soft_labels
from shotweave.operators.score import fit_scorer, pool_generated, relabel
from shotweave.sources.corpus import corpus
from shotweave.streaming.incremental import committed, incremental, read_sink, scratch_path, write_batch

K = 3


def test_hash_topk_at_most_k_and_smallest(spark):
    c = S.in_scope(corpus(spark, SF_SMALL)).where("split = 'train'")
    top = S.hash_topk(c, K)
    assert top.groupBy("intent").count().agg(F.max("count")).first()[0] <= K
    # every kept row has a smaller (sha1, row_id) than every dropped row of its class
    allr = c.withColumn("h", F.sha1("text")).select("intent", "h", "row_id")
    kept = top.withColumn("h", F.sha1("text")).select("intent", "h", "row_id")
    worst = kept.groupBy("intent").agg(F.max(F.struct("h", "row_id")).alias("w"))
    dropped = allr.join(kept, ["intent", "h", "row_id"], "left_anti").join(worst, "intent")
    assert dropped.where(F.struct("h", "row_id") < F.col("w")).count() == 0


def test_hash_topk_partition_invariant(spark):
    c = S.in_scope(corpus(spark, SF_SMALL)).where("split = 'train'")
    a = S.hash_topk(c.repartition(1), K).select("row_id", "rn").collect()
    b = S.hash_topk(c.repartition(16), K).select("row_id", "rn").collect()
    assert sorted(a) == sorted(b)


def test_m_union_f_is_corpus_minus_cut(spark):
    c = corpus(spark, SF_SMALL)
    slices = S.leave_one_domain_out(c, K)
    doms = S.bounded_values(S.in_scope(c), "domain")
    for d in doms[:2]:
        s = slices.where(F.col("val_domain") == d)
        ins = S.in_scope(c)
        cut = ins.where((F.col("domain") == d) & (F.col("split") == "train")).join(
            S.hash_topk(ins.where((F.col("domain") == d) & (F.col("split") == "train")), K).select("row_id"),
            "row_id", "left_anti")
        assert s.count() == ins.count() - cut.count()
        assert s.select("row_id").distinct().count() == s.count()


def test_upsample_count_equals_quota(spark):
    c = corpus(spark, SF_SMALL)
    p = A.build_prompts(S.few_shot_train(c, K), K)
    q = S.synthetic_quota(c)
    gen = A.upsample(p, q)
    want = p.join(q.withColumnRenamed("val_domain", "domain"), "domain").agg(F.sum("quota")).first()[0]
    assert gen.count() == want


def test_plan_requests_cover_quota(spark):
    df = spark.createDataFrame([("a", 0), ("b", 5), ("c", 300)], "k string, quota long")
    r = A.plan_requests(df, n_max=128)
    got = {row.k: row.s for row in r.groupBy("k").agg(F.sum("n").alias("s")).collect()}
    assert got == {"b": 5, "c": 300}
    assert r.where("k = 'c'").count() == 3


def test_accept_completions_exact_quota(spark):
    comp = spark.createDataFrame([(1, 0, 0, " a "), (1, 0, 1, ""), (1, 0, 2, "b"), (1, 1, 0, "c"), (2, 0, 0, "  ")],
                                 "request_id long, round int, choice_idx int, text string")
    req = spark.createDataFrame([(1, 2), (2, 1)], "request_id long, quota long")
    acc, short = A.accept_completions(comp, req)
    assert sorted(r.text for r in acc.collect()) == ["a", "b"]
    assert [(r.request_id, r.missing) for r in short.collect()] == [(2, 1)]


def test_resume_twice_adds_nothing(spark):
    plan = spark.createDataFrame([("d1", "eda"), ("d1", "upsample"), ("d2", "eda")], "domain string, attr string")
    done = spark.createDataFrame([("d1", "eda")], "domain string, attr string")
    first = A.resume(plan, done)
    assert first.count() == 2
    assert A.resume(plan, done.unionByName(first)).count() == 0


def test_soft_labels_sum_to_one_or_zero(spark):
    votes = spark.createDataFrame([(1, 0, 0.2), (1, 0, 0.4), (1, 2, 0.3)], "row_key long, label_id int, prob double")
    rows = spark.createDataFrame([(1,), (2,)], "row_key long")
    out = {r.row_key: r.label_vec for r in soft_labels(rows, normalise_votes(votes, label="label_id"), 3).collect()}
    assert abs(sum(out[1]) - 1.0) < 1e-12 and out[1][1] == 0.0 and sum(out[2]) == 0.0
    assert abs(out[1][0] - 0.5) < 1e-12


def test_assembly_full_domain_splits(spark):
    c = corpus(spark, SF_SMALL)
    oos = c.where("intent = 'oos'").select(F.max("intent_id")).first()[0]
    a = assemble("full_en", "baseline", c, k=K, oos_id=oos)
    splits = {r.split for r in a.select("split").distinct().collect()}
    assert splits <= {"train", "validation", "test", "full_validation", "full_test"}
    assert get_split(a, "full_test").count() == c.where("split = 'test'").count()


def test_stream_equals_batch_and_rerun_adds_nothing(spark):
    from shotweave.plans.q_io import SINK_SCHEMA
    c = corpus(spark, SF_SMALL)
    gen = A.upsample(A.build_prompts(S.few_shot_train(c, K), K), S.synthetic_quota(c))
    pool = pool_generated(gen, c, ["upsample"])
    model = fit_scorer(c.where("split = 'train'"))
    src, sink = scratch_path(spark, "t-src"), scratch_path(spark, "t-sink")
    halves = [pool.where(F.crc32(F.col("row_key").cast("binary")) % 2 == i) for i in (0, 1)]

    def label(b):
        return relabel(b, model)

    halves[0].write.parquet(src + "/part=0")
    assert incremental(spark, src, pool.schema, sink, label) == 1
    n1 = read_sink(spark, sink, SINK_SCHEMA).count()
    # the same rows in other files: their keys are known, only the others are scored
    pool.write.parquet(src + "/part=1")
    assert incremental(spark, src, pool.schema, sink, label) == 1
    assert incremental(spark, src, pool.schema, sink, label) == 0
    got = read_sink(spark, sink, SINK_SCHEMA)
    assert n1 == halves[0].count() and got.count() == pool.count()
    want = relabel(pool, model).select("row_key", "intent_id")
    assert got.select("row_key", "intent_id").exceptAll(want).count() == 0
    # a replayed batch overwrites its own folder
    write_batch(halves[0], 0, sink, lambda b: relabel(b, model))
    assert read_sink(spark, sink, SINK_SCHEMA).count() == pool.count()
    assert committed(spark, sink, 0) and committed(spark, sink, 1) and not committed(spark, sink, 2)
    with pytest.raises(ValueError, match="holds the batches"):
        incremental(spark, src, pool.schema, sink, label, checkpoint=scratch_path(spark, "t-ckpt"))


def test_stream_never_reads_its_sink(spark):
    src, sink = scratch_path(spark, "t-src"), scratch_path(spark, "t-sink")
    rows = spark.range(100).selectExpr("id", "cast(id % 40 as string) as row_key", "timestamp_seconds(id) as at")
    rows.write.parquet(src + "/part=0")
    files = []
    incremental(spark, src, rows.schema, sink, lambda b: files.extend(b.inputFiles()) or b, event_time="at")
    rows.write.parquet(src + "/part=1")
    incremental(spark, src, rows.schema, sink, lambda b: files.extend(b.inputFiles()) or b, event_time="at")
    assert files and all("/_arrived-" in f for f in files)
    assert read_sink(spark, sink, rows.schema).groupBy("row_key").count().where("count > 1").count() == 0
    assert read_sink(spark, sink, rows.schema).count() == 40
    assert read_sink(spark, scratch_path(spark, "none"), rows.schema).count() == 0
