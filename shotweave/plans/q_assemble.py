"""Registered training-set assembly queries (ASM-*) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotweave.operators import assemble as S
from shotweave.operators.augment import augment, build_prompts, upsample
from shotweave.operators.sample import few_shot_train, synthetic_quota
from shotweave.operators.score import fit_scorer, pool_generated, relabel
from shotweave.plans.catalog import register
from shotweave.plans.flagship import corpus_thesaurus
from shotweave.plans.flagship import corpus_scorer
from shotweave.plans.q_eda import DOMAIN_EDA_SQL, EDA_DOMAIN_ROWS
from shotweave.plans.q_mix import MIXED_SQL, N_SQL, q_mix06
from shotweave.plans.sqltext import (K, NB_SQL, POOL_SQL, PROMPTS_SQL, QUOTA_SQL, SEEDS_SQL, UPSAMPLE_SQL,
                                     with_corpus)
from shotweave.sources.corpus import corpus

OOS_SQL = "(SELECT intent_id FROM dim WHERE intent = 'oos')"
GEN = with_corpus(SEEDS_SQL, PROMPTS_SQL, QUOTA_SQL, UPSAMPLE_SQL)
EDA_GEN = DOMAIN_EDA_SQL + ", eda_rows AS (" + EDA_DOMAIN_ROWS + ")"

TRAIN_SEEDS = "SELECT 'train' AS split, text, intent_id FROM seeds"
OOS_TRAIN = f"SELECT 'train', text, intent_id FROM corpus WHERE split = 'train' AND intent_id = {OOS_SQL}"
EVAL = "SELECT split, text, intent_id FROM corpus WHERE split IN ('val', 'test')"


def _oos(c):
    return c.where(F.col("intent") == "oos").select(F.max("intent_id")).first()[0]


def _gen(c):
    return upsample(build_prompts(few_shot_train(c, K), K), synthetic_quota(c))


@register("asm01_route_config", GEN + f"""
SELECT 'few_pure' AS config, split, count(*) AS n_rows FROM (
  {TRAIN_SEEDS} UNION ALL {OOS_TRAIN} UNION ALL {EVAL}) a GROUP BY split
UNION ALL
SELECT 'full', split, count(*) FROM corpus GROUP BY split""")
def q_asm01(spark, sf):
    c = corpus(spark, sf)
    oos = _oos(c)
    parts = []
    for cfg in ("few_pure", "full"):
        a = S.assemble(cfg, "baseline", c, k=K, oos_id=oos, dataset_oos_id=oos)
        parts.append(a.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
                     .select(F.lit(cfg).alias("config"), "split", "n_rows"))
    return parts[0].unionByName(parts[1])


@register("asm02_few_pure_baseline", GEN + f"{TRAIN_SEEDS} UNION ALL {OOS_TRAIN} UNION ALL {EVAL}")
def q_asm02(spark, sf):
    c = corpus(spark, sf)
    oos = _oos(c)
    return S.assemble("few_pure", "baseline", c, k=K, oos_id=oos, dataset_oos_id=oos)


@register("asm03_few_pure_eda", EDA_GEN + f"""
{TRAIN_SEEDS} UNION ALL SELECT 'train', text, intent_id FROM eda_rows
UNION ALL {OOS_TRAIN} UNION ALL {EVAL}""")
def q_asm03(spark, sf):
    c = corpus(spark, sf)
    oos = _oos(c)
    p = build_prompts(few_shot_train(c, K), K)
    g = augment(p, synthetic_quota(c), modes=("eda",), thesaurus=corpus_thesaurus(spark, sf))
    return S.assemble("few_pure", "eda", c, k=K, oos_id=oos, dataset_oos_id=oos, generated=g)


@register("asm04_few_pure_generated", GEN + f"""
{TRAIN_SEEDS} UNION ALL SELECT 'train', text, intent_id FROM gen WHERE attr = 'upsample'
UNION ALL {OOS_TRAIN} UNION ALL {EVAL}""")
def q_asm04(spark, sf):
    c = corpus(spark, sf)
    oos = _oos(c)
    return S.assemble("few_pure", "generated", c, k=K, oos_id=oos, dataset_oos_id=oos,
                      generated=_gen(c), attr="upsample")


@register("asm05_few_pure_oracle", GEN + POOL_SQL + NB_SQL + f"""
{TRAIN_SEEDS} UNION ALL SELECT 'train', text, intent_id FROM relabelled WHERE attr = 'upsample'
UNION ALL {OOS_TRAIN} UNION ALL {EVAL}""")
def q_asm05(spark, sf):
    c = corpus(spark, sf)
    oos = _oos(c)
    rel = relabel(pool_generated(_gen(c), c, ["upsample"]), corpus_scorer(spark, sf))
    return S.assemble("few_pure", "upsample_oracle", c, k=K, oos_id=oos, dataset_oos_id=oos,
                      relabelled=rel, attr="upsample")


@register("asm07_oos_removed", GEN + f"""
{TRAIN_SEEDS} UNION ALL SELECT split, text, intent_id FROM corpus
WHERE split IN ('val', 'test') AND intent_id <> {OOS_SQL}""")
def q_asm07(spark, sf):
    c = corpus(spark, sf)
    return S.assemble("few_pure", "baseline", c, k=K, oos_id=None, dataset_oos_id=_oos(c))


@register("asm08_full_baseline", with_corpus() + "SELECT split, text, intent_id FROM corpus")
def q_asm08(spark, sf):
    return S.assemble("full", "baseline", corpus(spark, sf))


@register("asm09_full_intrinsic", EDA_GEN.replace(", sel AS (", ", sel AS (", 1) + f"""
SELECT split, text, intent_id FROM corpus WHERE intent_id <> {OOS_SQL}
UNION ALL SELECT attr, text, intent_id FROM gen WHERE domain <> 'oos'
UNION ALL SELECT attr, text, intent_id FROM eda_rows WHERE domain <> 'oos'""")
def q_asm09(spark, sf):
    c = corpus(spark, sf)
    p = build_prompts(few_shot_train(c, K), K)
    g = augment(p, synthetic_quota(c), modes=("upsample", "eda"), thesaurus=corpus_thesaurus(spark, sf))
    return S.assemble("full", "intrinsic", c, oos_id=_oos(c), generated=g, attrs=["upsample", "eda"])


FULL_DOMAIN_SQL = GEN + """
, fr AS (SELECT * FROM corpus WHERE intent <> 'oos' AND domain = 'en')
, ft AS (SELECT * FROM fr WHERE split = 'train'
         QUALIFY row_number() OVER (PARTITION BY intent ORDER BY sha1(text), row_id) <= 3)
, asm AS (
  SELECT 'train' AS split, text, intent_id FROM corpus WHERE intent <> 'oos' AND domain <> 'en' AND split = 'train'
  UNION ALL SELECT 'train', text, intent_id FROM ft
  UNION ALL SELECT 'train', text, intent_id FROM gen WHERE attr = 'upsample' AND domain = 'en'
  UNION ALL SELECT 'validation', text, intent_id FROM fr WHERE split = 'val'
  UNION ALL SELECT 'test', text, intent_id FROM fr WHERE split = 'test'
  UNION ALL SELECT 'full_validation', text, intent_id FROM corpus WHERE intent <> 'oos' AND split = 'val'
  UNION ALL SELECT 'full_test', text, intent_id FROM corpus WHERE intent <> 'oos' AND split = 'test'
  UNION ALL SELECT CASE split WHEN 'train' THEN 'train' WHEN 'val' THEN 'full_validation' ELSE 'full_test' END,
                   text, intent_id FROM corpus WHERE intent = 'oos'
)
"""


def _full_en(spark, sf):
    c = corpus(spark, sf)
    return S.assemble("full_en", "upsample", c, k=K, oos_id=_oos(c), generated=_gen(c))


@register("asm10_full_domain", FULL_DOMAIN_SQL + "SELECT * FROM asm")
def q_asm10(spark, sf):
    return _full_en(spark, sf)


@register("asm11_get_split", FULL_DOMAIN_SQL + "SELECT text, intent_id FROM asm WHERE split = 'full_test'")
def q_asm11(spark, sf):
    return S.get_split(_full_en(spark, sf), "full_test")


@register("asm06_few_pure_mixed", MIXED_SQL + f"""
SELECT 'train' AS split, text, label_vec FROM mixed
UNION ALL
SELECT split, text, list_transform(range({N_SQL}), lambda i: CASE WHEN i = intent_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
FROM corpus WHERE split IN ('val', 'test')""")
def q_asm06(spark, sf):
    c = corpus(spark, sf)
    oos = _oos(c)
    n = c.select("intent_id").distinct().count()
    mixed = q_mix06(spark, sf).drop("origin")
    return S.assemble("few_pure", "gpt3mix", c, k=K, oos_id=oos, dataset_oos_id=oos, mixed=mixed, num_labels=n)
