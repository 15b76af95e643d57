"""Registered metric queries (MET-*) with their oracles.

Prediction batches come from the given tables: ``embeddings`` (label, the
argmax over all vector components, modulo 10, as prediction, class 9 playing OOS)
and the naive Bayes scorer applied to the corpus.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shotweave.functions.arrays import argmax
from shotweave.operators import metrics as M
from shotweave.plans.catalog import register
from shotweave.plans.flagship import upsample_relabelled
from shotweave.plans.sqltext import (FLAGSHIP_SQL, K, NB_SQL, POOL_SQL, PROMPTS_SQL, QUOTA_SQL,
                                     SEEDS_SQL, UPSAMPLE_SQL, with_corpus)
from shotweave.sources.corpus import split_of

OOS = 9
NUM_LABELS = 10

PRED_SQL = f"""
WITH p AS (
  SELECT vec_id, label,
         CAST((list_position(embedding, list_max(embedding)) - 1) % {NUM_LABELS} AS INTEGER) AS pred,
         CASE WHEN substr(sha1(CAST(vec_id AS VARCHAR)), 1, 1) < 'c' THEN 'train'
              WHEN substr(sha1(CAST(vec_id AS VARCHAR)), 1, 1) < 'e' THEN 'val' ELSE 'test' END AS split
  FROM embeddings
)
"""


def predictions(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", "label", (argmax(F.col("embedding")) % NUM_LABELS).alias("pred"),
                    split_of(F.col("vec_id")).alias("split"))


def per_class_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""
  SELECT {g}cls, sum(tp) AS tp, sum(t) AS t, sum(p) AS p FROM (
    SELECT {g}label AS cls, n AS t, 0 AS p, CASE WHEN label = pred THEN n ELSE 0 END AS tp FROM {src}
    UNION ALL SELECT {g}pred, 0, n, 0 FROM {src}) x GROUP BY {g}cls"""


F1 = "round(avg(CASE WHEN t + p > 0 THEN 2.0 * tp / (t + p) ELSE 0.0 END), 6)"
PREC = "round(avg(CASE WHEN p > 0 THEN tp / p ELSE 0.0 END), 6)"
REC = "round(avg(CASE WHEN t > 0 THEN tp / t ELSE 0.0 END), 6)"
COUNTS = ", counts AS (SELECT label, pred, count(*) AS n FROM p GROUP BY label, pred)"
COUNTS_IN = f", counts_in AS (SELECT * FROM counts WHERE label <> {OOS})"


@register("met01_accuracy", PRED_SQL + """
SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_rows FROM p""")
def q_met01(spark, sf):
    return M.accuracy_scores(M.confusion_counts(predictions(spark, sf))).select("accuracy", "n_rows")


@register("met02_inscope_accuracy", PRED_SQL + f"""
SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS inscope_accuracy FROM p WHERE label <> {OOS}""")
def q_met02(spark, sf):
    return M.accuracy_scores(M.confusion_counts(predictions(spark, sf)), oos_id=OOS).select("inscope_accuracy")


@register("met03_macro_f1", PRED_SQL + COUNTS + f", pc AS ({per_class_sql('counts')}) SELECT {F1} AS f1 FROM pc")
def q_met03(spark, sf):
    return M.macro_scores(M.confusion_counts(predictions(spark, sf))).select("f1")


@register("met04_inscope_f1", PRED_SQL + COUNTS + COUNTS_IN
          + f", pc AS ({per_class_sql('counts_in')}) SELECT {F1} AS inscope_f1 FROM pc")
def q_met04(spark, sf):
    c = M.confusion_counts(predictions(spark, sf)).where(F.col("label") != OOS)
    return M.macro_scores(c, prefix="inscope_").select("inscope_f1")


@register("met05_macro_precision", PRED_SQL + COUNTS + f", pc AS ({per_class_sql('counts')}) SELECT {PREC} AS precision FROM pc")
def q_met05(spark, sf):
    return M.macro_scores(M.confusion_counts(predictions(spark, sf))).select("precision")


@register("met06_macro_recall", PRED_SQL + COUNTS + f", pc AS ({per_class_sql('counts')}) SELECT {REC} AS recall FROM pc")
def q_met06(spark, sf):
    return M.macro_scores(M.confusion_counts(predictions(spark, sf))).select("recall")


@register("met07_oos_recall", PRED_SQL + f"""
SELECT round(avg(CASE WHEN pred = {OOS} THEN 1.0 ELSE 0.0 END), 6) AS oos_recall FROM p WHERE label = {OOS}""")
def q_met07(spark, sf):
    return M.accuracy_scores(M.confusion_counts(predictions(spark, sf)), oos_id=OOS).select("oos_recall")


@register("met08_confusion_matrix", PRED_SQL + COUNTS + f"""
, grid AS (SELECT CAST(i // {NUM_LABELS} AS INTEGER) AS label, CAST(i % {NUM_LABELS} AS INTEGER) AS pred
           FROM range({NUM_LABELS * NUM_LABELS}) r(i))
SELECT g.label, g.pred, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN counts c USING (label, pred)""")
def q_met08(spark, sf):
    return M.confusion_matrix(spark, predictions(spark, sf), NUM_LABELS)


RELABELLED = with_corpus(SEEDS_SQL, PROMPTS_SQL, QUOTA_SQL, UPSAMPLE_SQL, POOL_SQL, NB_SQL)


@register("met09_fidelity", RELABELLED + """
SELECT CASE WHEN attr = 'val' THEN 'threshold' ELSE attr END AS attr,
       round(avg(CASE WHEN old_intent_id = intent_id THEN 1.0 ELSE 0.0 END), 6) AS fidelity,
       count(*) AS n_rows
FROM relabelled GROUP BY 1""")
def q_met09(spark, sf):
    return M.fidelity(upsample_relabelled(spark, sf, K))


@register("met10_classwise_fidelity", RELABELLED + """
SELECT attr, old_intent, round(avg(CASE WHEN old_intent = intent THEN 1.0 ELSE 0.0 END), 6) AS agreement,
       count(*) AS n_rows
FROM relabelled GROUP BY ROLLUP (attr, old_intent)""")
def q_met10(spark, sf):
    return M.classwise(upsample_relabelled(spark, sf, K), "old_intent", "old_intent", "intent",
                       group=("attr",))


@register("met11_pct_text", PRED_SQL + """
SELECT label, round(acc * 100.0, 6) AS pct,
       CAST(h // 100 AS VARCHAR) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') AS pct_text
FROM (SELECT label, acc, CAST(round(acc * 10000.0) AS BIGINT) AS h FROM (
  SELECT label, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS acc FROM p GROUP BY label) a) b""")
def q_met11(spark, sf):
    p = predictions(spark, sf)
    acc = p.groupBy("label").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("acc"))
    return acc.select("label", F.round(F.col("acc") * 100.0, 6).alias("pct"),
                      M.pct_text(F.col("acc")).alias("pct_text"))


TTR_TOKEN_SQL = "regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+|[^\\p{L}\\p{N}\\s]')"


def ttr_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""
, toks AS (SELECT {g}{TTR_TOKEN_SQL} AS t FROM {src}),
grams AS (
  SELECT {g}n, list_aggregate(t[i + 1:i + n], 'string_agg', chr(1)) AS gram
  FROM toks, (SELECT unnest([1, 2, 3, 4]) AS n) ns, LATERAL (SELECT unnest(range(len(t) - n + 1)) AS i) r
), per_gram AS (SELECT {g}n, gram, count(*) AS c FROM grams GROUP BY ALL)
SELECT {g}n, count(*) AS types, CAST(sum(c) AS BIGINT) AS tokens, round(count(*) / sum(c), 6) AS ttr
FROM per_gram GROUP BY ALL"""


@register("met12_ttr", with_corpus() + ttr_sql("corpus"))
def q_met12(spark, sf):
    from shotweave.sources.corpus import corpus
    return M.ttr(corpus(spark, sf), passes=M.GRAM_PASSES).withColumn("n", F.col("n"))


@register("met13_ttr_per_generator", with_corpus(SEEDS_SQL, PROMPTS_SQL, QUOTA_SQL, UPSAMPLE_SQL)
          + ttr_sql("(SELECT attr, text FROM gen WHERE domain <> 'oos')", "attr"))
def q_met13(spark, sf):
    from shotweave.operators.augment import build_prompts, upsample
    from shotweave.operators.sample import few_shot_train, synthetic_quota
    from shotweave.sources.corpus import corpus
    c = corpus(spark, sf)
    gen = upsample(build_prompts(few_shot_train(c, K), K), synthetic_quota(c))
    return M.ttr(gen.where(F.col("domain") != "oos"), group=("attr",))


@register("met14_metric_dispatch", PRED_SQL + f"""
, counts AS (SELECT split, label, pred, count(*) AS n FROM p GROUP BY ALL)
, counts_in AS (SELECT * FROM counts WHERE label <> {OOS})
, pc AS ({per_class_sql('counts', 'split')})
, pci AS ({per_class_sql('counts_in', 'split')})
, acc AS (
  SELECT split, round(sum(CASE WHEN label = pred THEN n ELSE 0 END) / sum(n), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS n_rows,
         round(sum(CASE WHEN label <> {OOS} THEN CASE WHEN label = pred THEN n ELSE 0 END END) / sum(CASE WHEN label <> {OOS} THEN n END), 6) AS inscope_accuracy,
         round(sum(CASE WHEN label = {OOS} THEN CASE WHEN label = pred THEN n ELSE 0 END END) / sum(CASE WHEN label = {OOS} THEN n END), 6) AS oos_recall
  FROM counts GROUP BY split)
SELECT a.*, m.f1, i.inscope_f1, m.precision, m.recall FROM acc a
JOIN (SELECT split, {F1} AS f1, {PREC} AS precision, {REC} AS recall FROM pc GROUP BY split) m USING (split)
LEFT JOIN (SELECT split, {F1} AS inscope_f1 FROM pci GROUP BY split) i USING (split)""")
def q_met14(spark, sf):
    return M.compute_metrics(predictions(spark, sf), ["recall", "precision", "f1", "accuracy"],
                             group=("split",), oos_id=OOS)


@register("met15_evaluate_splits", PRED_SQL + f"""
, q AS (SELECT *, 'few_shot' AS scope, CASE WHEN contains(split, 'test') THEN 'test' ELSE 'valid' END AS prefix
        FROM p WHERE split <> 'train')
, counts AS (SELECT scope, prefix, split, label, pred, count(*) AS n FROM q GROUP BY ALL)
, counts_in AS (SELECT * FROM counts WHERE label <> {OOS})
, pc AS ({per_class_sql('counts', 'scope, prefix, split')})
, pci AS ({per_class_sql('counts_in', 'scope, prefix, split')})
, acc AS (
  SELECT scope, prefix, split, round(sum(CASE WHEN label = pred THEN n ELSE 0 END) / sum(n), 6) AS accuracy,
         CAST(sum(n) AS BIGINT) AS n_rows,
         round(sum(CASE WHEN label <> {OOS} THEN CASE WHEN label = pred THEN n ELSE 0 END END) / sum(CASE WHEN label <> {OOS} THEN n END), 6) AS inscope_accuracy,
         round(sum(CASE WHEN label = {OOS} THEN CASE WHEN label = pred THEN n ELSE 0 END END) / sum(CASE WHEN label = {OOS} THEN n END), 6) AS oos_recall
  FROM counts GROUP BY ALL)
SELECT a.*, m.f1, i.inscope_f1, m.precision, m.recall FROM acc a
JOIN (SELECT scope, prefix, split, {F1} AS f1, {PREC} AS precision, {REC} AS recall FROM pc GROUP BY ALL) m
  USING (scope, prefix, split)
LEFT JOIN (SELECT scope, prefix, split, {F1} AS inscope_f1 FROM pci GROUP BY ALL) i USING (scope, prefix, split)""")
def q_met15(spark, sf):
    return M.evaluate_splits(predictions(spark, sf), oos_id=OOS)


_ = FLAGSHIP_SQL
