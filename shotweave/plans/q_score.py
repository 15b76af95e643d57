"""Registered relabelling, scoring and voting queries (PRD-*) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotweave.functions.arrays import argmax, softmax
from shotweave.functions.text import regex_tokens
from shotweave.operators import score as P
from shotweave.operators.augment import build_prompts, upsample
from shotweave.operators.sample import few_shot_train, synthetic_quota
from shotweave.plans.catalog import register
from shotweave.plans.flagship import corpus_scorer
from shotweave.plans.sqltext import (K, NB_SQL, POOL_SQL, PROMPTS_SQL, QUOTA_SQL, SEEDS_SQL,
                                     UPSAMPLE_SQL, with_corpus)
from shotweave.sources.corpus import corpus, load_table

POOL = with_corpus(SEEDS_SQL, PROMPTS_SQL, QUOTA_SQL, UPSAMPLE_SQL, POOL_SQL)
RELABELLED = POOL + NB_SQL.format(k=K)


def _pool(spark, sf):
    c = corpus(spark, sf)
    gen = upsample(build_prompts(few_shot_train(c, K), K), synthetic_quota(c))
    return c, P.pool_generated(gen, c, attrs=["upsample"])


@register("prd01_pool_generated", POOL + "SELECT * FROM pool")
def q_prd01(spark, sf):
    return _pool(spark, sf)[1]


@register("prd02_fit_scorer", with_corpus() + NB_SQL.split(", pool_tok AS")[0] + """
SELECT intent_id, intent, (SELECT count(*) FROM train_tok t WHERE t.intent_id = s.intent_id) AS n_rows,
       round(lp, 9) AS log_prior, round(ld, 9) AS log_denom FROM stats s""")
def q_prd02(spark, sf):
    c = corpus(spark, sf)
    m = P.fit_scorer(c.where(F.col("split") == "train"))
    return m.class_stats.select("intent_id", "intent", "n_rows", F.round("log_prior", 9).alias("log_prior"),
                                F.round("log_denom", 9).alias("log_denom"))


@register("prd02_token_counts", with_corpus() + NB_SQL.split(", stats AS")[0] + "SELECT * FROM tok_counts")
def q_prd02t(spark, sf):
    c = corpus(spark, sf)
    return P.fit_scorer(c.where(F.col("split") == "train")).token_counts


@register("prd03_score_rows", RELABELLED + """
SELECT row_key, list(score ORDER BY intent_id) AS scores FROM scores GROUP BY row_key""")
def q_prd03(spark, sf):
    c, pool = _pool(spark, sf)
    m = corpus_scorer(spark, sf)
    return P.score_rows(pool, m).select("row_key", "scores")


@register("prd04_softmax_argmax", """
SELECT vec_id, list_transform(p, lambda x: round(x, 6)) AS probs,
       CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred
FROM (SELECT vec_id, embedding,
             list_transform(embedding, lambda x: exp(x - list_max(embedding))) AS e FROM embeddings) t,
     LATERAL (SELECT list_transform(e, lambda x: x / list_sum(e)) AS p) q""")
def q_prd04(spark, sf):
    e = load_table(spark, sf, "embeddings").withColumn("v", F.col("embedding"))
    return e.select("vec_id", F.transform(softmax(F.col("v")), lambda x: F.round(x, 6)).alias("probs"),
                    argmax(F.col("v")).alias("pred"))


@register("prd05_relabel", RELABELLED + "SELECT attr, row_key, old_intent_id, intent_id, intent FROM relabelled")
def q_prd05(spark, sf):
    c, pool = _pool(spark, sf)
    m = corpus_scorer(spark, sf)
    return P.relabel(pool, m).select("attr", "row_key", "old_intent_id", "intent_id", "intent")


CANDIDATE_IDS = [7, 1, 4]


@register("prd06_restricted_argmax", """
SELECT vec_id, CAST([1, 4, 7][list_position(l, list_max(l))] AS INTEGER) AS pred FROM (
  SELECT vec_id, [embedding[2], embedding[5], embedding[8]] AS l FROM embeddings) t""")
def q_prd06(spark, sf):
    e = load_table(spark, sf, "embeddings")
    return e.select("vec_id", P.restricted_argmax(F.col("embedding"), CANDIDATE_IDS).cast("int").alias("pred"))


# The candidate answers a vote chooses from, in priority order.
VOTE_CANDIDATES = ["click", "view", "purchase", "signup", "error"]
CAND_SQL = "[" + ", ".join(f"'{c}'" for c in VOTE_CANDIDATES) + "]"

VOTE_SQL = f"""
WITH cand AS (SELECT unnest({CAND_SQL}) AS candidate, CAST(unnest(range(5)) AS INTEGER) AS pos),
counts AS (SELECT user_id, trim(event_type) AS candidate, count(*) AS n FROM events GROUP BY ALL),
users AS (SELECT DISTINCT user_id FROM events),
scored AS (
  SELECT u.user_id, c.candidate, c.pos, coalesce(n.n, 0) AS n FROM users u, cand c
  LEFT JOIN counts n ON n.user_id = u.user_id AND n.candidate = c.candidate
), votes AS (
  SELECT user_id AS row_id, candidate AS vote FROM scored
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, pos) = 1
), firsts AS (
  SELECT user_id AS row_id, arg_min(event_type, (ts, event_id)) AS old_intent FROM events GROUP BY user_id
)
"""


def _votes(spark, sf):
    ev = load_table(spark, sf, "events")
    responses = ev.select(F.col("user_id").alias("row_id"), F.col("event_type").alias("response"))
    cands = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(i).alias("pos"))
                      for i, c in enumerate(VOTE_CANDIDATES)])
    candidates = (ev.select(F.col("user_id").alias("row_id")).distinct()
                  .select("row_id", F.explode(cands).alias("c")).select("row_id", "c.candidate", "c.pos"))
    votes = P.majority_vote(responses, candidates)
    firsts = ev.groupBy(F.col("user_id").alias("row_id")).agg(
        F.min_by("event_type", F.struct("ts", "event_id")).alias("old_intent"))
    return votes, firsts


@register("prd07_majority_vote", VOTE_SQL + "SELECT * FROM votes")
def q_prd07(spark, sf):
    return _votes(spark, sf)[0]


@register("prd08_vote_filter", VOTE_SQL + """
SELECT f.row_id, f.old_intent, v.vote FROM firsts f JOIN votes v USING (row_id) WHERE v.vote = f.old_intent""")
def q_prd08(spark, sf):
    votes, firsts = _votes(spark, sf)
    return P.vote_filter(firsts, votes)[0].select("row_id", "old_intent", "vote")


@register("prd08_vote_report", VOTE_SQL + """
SELECT count(*) FILTER (WHERE v.vote = f.old_intent) AS kept, count(*) AS total,
       round(100.0 * count(*) FILTER (WHERE v.vote = f.old_intent) / count(*), 2) AS pct
FROM firsts f LEFT JOIN votes v USING (row_id)""")
def q_prd08r(spark, sf):
    votes, firsts = _votes(spark, sf)
    return P.vote_filter(firsts, votes)[1]


@register("prd09_vote_classify", VOTE_SQL + """
SELECT f.old_intent, round(avg(CASE WHEN v.vote = f.old_intent THEN 1.0 ELSE 0.0 END), 6) AS agreement,
       count(*) AS n_rows
FROM firsts f JOIN votes v USING (row_id) GROUP BY ROLLUP (f.old_intent)""")
def q_prd09(spark, sf):
    from shotweave.operators.metrics import classwise
    votes, firsts = _votes(spark, sf)
    return classwise(firsts.join(votes, "row_id"), "old_intent", "old_intent", "vote")


PROMPT_INTENTS_SQL = "(SELECT intent FROM corpus WHERE intent <> 'oos' GROUP BY intent ORDER BY intent LIMIT 3)"


@register("prd10_classification_prompt", with_corpus(SEEDS_SQL) + f"""
, cats AS (SELECT string_agg(intent, ', ' ORDER BY intent) AS c FROM {PROMPT_INTENTS_SQL} t),
body AS (
  SELECT string_agg('sentence: ' || text || ' ; category: ' || intent, chr(10) ORDER BY intent, text) AS b
  FROM seeds WHERE intent IN {PROMPT_INTENTS_SQL}
)
SELECT c.row_id,
       'Each example in the following list contains a sentence that belongs to a category. '
       || 'A category is one of the following: ' || (SELECT c FROM cats) || chr(10) || chr(10)
       || (SELECT b FROM body) || chr(10) || 'sentence: ' || c.text || ' ; category:' AS prompt
FROM corpus c WHERE c.intent IN {PROMPT_INTENTS_SQL}""")
def q_prd10(spark, sf):
    c = corpus(spark, sf)
    cats = [r[0] for r in c.where(F.col("intent") != "oos").select("intent").distinct()
            .orderBy("intent").limit(3).collect()]
    seeds = few_shot_train(c, K).where(F.col("intent").isin(cats))
    prefix = P.classification_prompt(seeds, cats)
    rows = c.where(F.col("intent").isin(cats))
    return rows.select("row_id", P.classification_query(prefix, F.col("text")).alias("prompt"))


@register("prd11_token_truncation", with_corpus() + """
SELECT row_id, regexp_extract_all(lower(text), '[a-z]+')[1:50] AS tokens FROM corpus""")
def q_prd11(spark, sf):
    return corpus(spark, sf).select("row_id", regex_tokens(F.col("text")).alias("tokens"))
