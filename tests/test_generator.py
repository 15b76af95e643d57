"""The generator hook: per-task state, retries to the exact quota, and its bound."""

import os
import sys
import uuid

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from shotweave.operators import augment as A
from shotweave.streaming.incremental import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests
SCHEMA = "domain string, intent string, intent_id int, prompt_id int, prompt string, quota long"


def prompts(spark, quotas):
    rows = [("d", f"d_{i % 3}", i % 3, i, f"prompt {i}", q) for i, q in enumerate(quotas)]
    return spark.createDataFrame(rows, SCHEMA)


def answers(batch, text):
    rows = [(*r[:5], text(r, j)) for r in batch[[*A.REQUEST_KEY, "n"]].itertuples(index=False, name=None) for j in range(r[5])]
    return pd.DataFrame(rows, columns=[*A.REQUEST_KEY, "text"])


def test_failed_answers_are_asked_for_again(spark):
    quotas = [0, 1, 2, 7, 40, 301]
    p = prompts(spark, quotas)
    gen = A.each_batch(lambda b: answers(b, lambda r, j: f" {r[3]}.{r[4]}.{j}\n" if (r[4] + j) % 2 else "  "))
    got = A.complete_quota(p, "quota", gen, n_max=8).groupBy("prompt_id").agg(
        F.count("*"), F.countDistinct("gen_idx"), F.min("gen_idx"), F.max("gen_idx"), F.countDistinct("text")).collect()
    assert sorted(map(tuple, got)) == [(i, q, q, 0, q - 1, q) for i, q in enumerate(quotas) if q]


def test_too_many_answers_are_cut(spark):
    gen = A.each_batch(lambda b: pd.concat([answers(b, lambda r, j: f"first {j}"), answers(b, lambda r, j: "more")]))
    got = A.complete_quota(prompts(spark, [5, 9]), "quota", gen, n_max=4)
    assert got.count() == 14 and got.where("text = 'more'").count() == 0


def test_rounds_are_bounded(spark):
    with pytest.raises(RuntimeError, match="1 prompts miss texts after 3 rounds"):
        A.complete_quota(prompts(spark, [3]), "quota", A.each_batch(lambda b: answers(b, lambda r, j: None)), max_rounds=3)


def test_a_model_is_loaded_once_per_task(spark):
    folder = scratch_path(spark, "loads").removeprefix("file:")
    os.makedirs(folder)

    def load():
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return "model"

    requests = A.plan_requests(prompts(spark, [400] * 6), n_max=1)  # 2,400 requests
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        out = A.complete(requests, A.with_model(load, lambda m, b: answers(b, lambda r, j: m)), n_max=1)
        rows = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    tasks = len({r.task for r in rows})
    assert len(rows) == 2400 and tasks == 8 and len(os.listdir(folder)) == tasks
    assert {r.text for r in rows} == {"model"} and len({(r.prompt_id, r.gen_idx) for r in rows}) == 2400


def test_generator_mode_of_augment(spark):
    p = prompts(spark, [1, 1]).drop("quota").withColumn("lines", F.array(F.lit("x")))
    quota = spark.createDataFrame([("d", 6)], "val_domain string, quota long")
    out = A.augment(p, quota, modes=("upsample", "gptj_1.0"), generator=A.each_batch(lambda b: answers(b, lambda r, j: "" if j % 3 else f"t{j}")))
    assert sorted(map(tuple, out.groupBy("attr").count().collect())) == [("gptj_1.0", 12), ("upsample", 12)]
    with pytest.raises(ValueError, match="needs a generator"):
        A.augment(p, quota, modes=("gpt",))
