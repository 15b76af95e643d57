"""Flagship: how faithful is the upsampled few-shot set to a scorer fitted on all data?

corpus -> hash top-K seeds -> prompts -> per-domain quota -> upsample ->
naive Bayes fitted on the full train split -> relabel generated + val/test ->
fidelity by attr, overall and per domain (rollup).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.operators.augment import build_prompts, upsample
from shotweave.operators.labels import prefix_domain
from shotweave.operators.metrics import ROUND
from shotweave.operators.sample import few_shot_train, synthetic_quota
from shotweave.operators.score import fit_scorer_table, pool_generated, relabel
from shotweave.sources.corpus import corpus, corpus_inputs, build_corpus


def upsample_relabelled(spark: SparkSession, sf_dir: str, k: int = 3,
                        scaffold: bool = False) -> DataFrame:
    c = corpus(spark, sf_dir)
    seeds = few_shot_train(c, k)
    prompts = build_prompts(seeds, num_ex=k)
    gen = upsample(prompts, synthetic_quota(c), scaffold=scaffold)
    model = corpus_scorer(spark, sf_dir)
    return relabel(pool_generated(gen, c, attrs=["upsample"]), model)


def corpus_thesaurus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thesaurus derived from the corpus vocabulary, stored per input version."""
    from shotweave.operators.eda import vocabulary_thesaurus
    from shotweave.sources.tables import materialized
    return materialized(spark, "thesaurus", corpus_inputs(sf_dir),
                        lambda: vocabulary_thesaurus(corpus(spark, sf_dir)))


def corpus_scorer(spark: SparkSession, sf_dir: str):
    """The scorer fitted on the corpus train split, stored as tables per input version."""
    return fit_scorer_table(spark, "scorer", corpus_inputs(sf_dir),
                            lambda: corpus(spark, sf_dir).where(F.col("split") == "train"))


def flagship(spark: SparkSession, sf_dir: str, k: int = 3, scaffold: bool = False) -> DataFrame:
    rel = upsample_relabelled(spark, sf_dir, k, scaffold)
    r = (rel.withColumn("domain", prefix_domain(F.col("old_intent")))
         .withColumn("same_intent", (F.col("intent_id") == F.col("old_intent_id")).cast("double"))
         .withColumn("same_domain",
                     (prefix_domain(F.col("intent")) == F.col("domain")).cast("double")))
    attr = F.when(F.col("attr") == "val", F.lit("threshold")).otherwise(F.col("attr"))
    return (r.withColumn("attr", attr).rollup("attr", "domain")
            .agg(F.round(F.avg("same_intent"), ROUND).alias("fidelity"),
                 F.round(F.avg("same_domain"), ROUND).alias("domain_fidelity"),
                 F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("attr").isNotNull()))
