"""Registered augmentation queries (AUG-*) with their oracles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from shotweave.functions.text import CLEAN_SQL, STOP_WORDS, STRIP_SQL, clean_chars, py_strip, words_of
from shotweave.operators import augment as A
from shotweave.operators.sample import few_shot_train, synthetic_quota
from shotweave.plans.catalog import register
from shotweave.plans.sqltext import (K, PROMPTS_SQL, QUOTA_SQL, SEEDS_SQL, UPSAMPLE_SQL, with_corpus)
from shotweave.sources.corpus import corpus, load_table
from shotweave.sources.tables import durable

PROMPTS = with_corpus(SEEDS_SQL, PROMPTS_SQL)
GEN = with_corpus(SEEDS_SQL, PROMPTS_SQL, QUOTA_SQL, UPSAMPLE_SQL)


def prompts_of(spark, sf):
    c = corpus(spark, sf)
    return c, A.build_prompts(few_shot_train(c, K), K)


@register("aug01_build_prompts", PROMPTS + "SELECT domain, intent, intent_id, prompt_id, prompt FROM prompts")
def q_aug01(spark, sf):
    return prompts_of(spark, sf)[1].drop("lines")


@register("aug02_upsample", GEN + "SELECT * FROM gen")
def q_aug02(spark, sf):
    c, p = prompts_of(spark, sf)
    return A.upsample(p, synthetic_quota(c))


@register("aug02_upsample_scaffold", with_corpus(SEEDS_SQL, PROMPTS_SQL, QUOTA_SQL) + """
, pl AS (SELECT *, string_split(trim(prompt), chr(10)) AS sl FROM prompts)
SELECT p.domain, 'upsample' AS attr, p.intent, p.intent_id, p.prompt_id, CAST(g.i AS BIGINT) AS gen_idx,
       p.sl[(g.i % len(p.sl)) + 1] AS text
FROM pl p JOIN quota q ON p.domain = q.val_domain, LATERAL (SELECT unnest(range(q.quota)) AS i) g""")
def q_aug02s(spark, sf):
    c, p = prompts_of(spark, sf)
    return A.upsample(p, synthetic_quota(c), scaffold=True)


@register("aug03_clean_chars", with_corpus() + f"SELECT row_id, {CLEAN_SQL.format(x='text')} AS clean FROM corpus")
def q_aug03(spark, sf):
    return corpus(spark, sf).select("row_id", clean_chars(F.col("text")).alias("clean"))


STOP_SQL = "[" + ", ".join("'" + w + "'" for w in STOP_WORDS) + "]"


@register("aug04_stopword_removal", with_corpus() + f"""
, w AS (SELECT row_id, list_filter(string_split({CLEAN_SQL.format(x='text')}, ' '), lambda x: x <> '') AS words
        FROM corpus)
SELECT row_id, list_filter(words, lambda x, i: list_position(words, x) = i AND NOT list_contains({STOP_SQL}, x))
       AS candidates FROM w""")
def q_aug04(spark, sf):
    from shotweave.operators.eda import candidate_words
    c = corpus(spark, sf)
    return c.select("row_id", candidate_words(words_of(clean_chars(F.col("text")))).alias("candidates"))


@register("aug12_plan_requests", with_corpus(SEEDS_SQL, PROMPTS_SQL, QUOTA_SQL) + """
, pq AS (SELECT p.domain, p.intent, p.prompt_id, q.quota FROM prompts p JOIN quota q ON p.domain = q.val_domain)
SELECT domain, intent, prompt_id, quota, CAST(r AS INTEGER) AS req_idx, CAST(least(4, quota - r * 4) AS BIGINT) AS n
FROM pq, LATERAL (SELECT unnest(range(CAST(ceil(quota / 4) AS BIGINT))) AS r) x
WHERE least(4, quota - r * 4) > 0""")
def q_aug12(spark, sf):
    c, p = prompts_of(spark, sf)
    q = synthetic_quota(c).withColumnRenamed("val_domain", "domain")
    return A.plan_requests(p.join(q, "domain").select("domain", "intent", "prompt_id", "quota"), n_max=4)


def conversation_completions(spark, sf):
    """Requests = conversations (quota = number of user turns); completions =
    lines of the assistant turns (round = turn, choice = line index)."""
    conv = load_table(spark, sf, "conversations")
    requests = (conv.groupBy(F.col("conv_id").alias("request_id"))
                .agg(F.count_if(F.col("role") == "user").alias("quota")))
    comp = (conv.where(F.col("role") == "assistant")
            .select(F.col("conv_id").alias("request_id"), F.col("turn").alias("round"),
                    F.posexplode(F.split("text", "\n")).alias("choice_idx", "text")))
    return requests, comp


CONV_SQL = """
WITH requests AS (
  SELECT conv_id AS request_id, count(*) FILTER (WHERE role = 'user') AS quota FROM conversations GROUP BY conv_id
), comp AS (
  SELECT conv_id AS request_id, turn AS round, CAST(i - 1 AS INTEGER) AS choice_idx, string_split(text, chr(10))[i] AS text
  FROM conversations, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) x
  WHERE role = 'assistant'
), acc AS (
  SELECT * FROM (
    SELECT c.request_id, c.round, c.choice_idx, """ + STRIP_SQL.format(x="c.text") + """ AS text, r.quota
    FROM comp c JOIN requests r USING (request_id)) t
  WHERE text <> ''
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round, choice_idx) <= quota
)
"""


@register("aug13_accept_completions", CONV_SQL + """
SELECT request_id, round, choice_idx, text,
       CAST(row_number() OVER (PARTITION BY request_id ORDER BY round, choice_idx) AS INTEGER) AS accept_rank
FROM acc""")
def q_aug13(spark, sf):
    req, comp = conversation_completions(spark, sf)
    return A.accept_completions(comp, req)[0]


@register("aug13_shortfall", CONV_SQL + """
SELECT r.request_id, r.quota, r.quota - coalesce(g.got, 0) AS missing
FROM requests r LEFT JOIN (SELECT request_id, count(*) AS got FROM acc GROUP BY request_id) g USING (request_id)
WHERE r.quota - coalesce(g.got, 0) > 0""")
def q_aug13s(spark, sf):
    req, comp = conversation_completions(spark, sf)
    return A.accept_completions(comp, req)[1]


@register("aug14_extract_continuation", """
WITH pairs AS (
  SELECT conv_id AS request_id, turn AS choice_idx, text AS prompt,
         text || lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS output, role
  FROM conversations
), x AS (
  SELECT request_id, choice_idx, len(string_split(prompt, chr(10))) - 1 AS k, output FROM pairs
  WHERE role = 'user' AND output IS NOT NULL
), y AS (
  SELECT request_id, choice_idx, """ + STRIP_SQL.format(
    x="substr(string_split(output, chr(10))[k + 1], len('Example ' || CAST(k - 1 AS VARCHAR) || ': ') + 1)") + """ AS text
  FROM x
)
SELECT request_id, choice_idx, text FROM y WHERE text IS NOT NULL AND text <> ''
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY choice_idx) <= 2""")
def q_aug14(spark, sf):
    conv = load_table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = (conv.withColumn("output", F.concat("text", F.lead("text").over(w)))
             .where((F.col("role") == "user") & F.col("output").isNotNull())
             .select(F.col("conv_id").alias("request_id"), F.col("turn").alias("choice_idx"),
                     F.col("text").alias("prompt"), "output"))
    return A.extract_continuation(pairs, n=2).select("request_id", "choice_idx", "text")


GRID_SQL = ("[" + ", ".join(f"{{'engine': '{e}', 'temp': '1.0'}}" for e in A.ENGINES) + ", "
            + ", ".join(f"{{'engine': 'gptj', 'temp': '{t}'}}" for t in A.SWEEP_TEMPS) + "]")


@register("aug15_attr_grid", PROMPTS + f"""
SELECT domain, intent, prompt_id, g.engine, g.temp, g.engine || '_' || g.temp AS attr
FROM prompts, LATERAL (SELECT unnest({GRID_SQL}, recursive := true)) g""")
def q_aug15(spark, sf):
    p = prompts_of(spark, sf)[1].select("domain", "intent", "prompt_id")
    return (A.with_attr_grid(p, A.ENGINES, A.DEFAULT_TEMPS)
            .unionByName(A.with_attr_grid(p, ["gptj"], A.SWEEP_TEMPS)))


@register("aug17_resume", GEN + f"""
, plan AS (
  SELECT DISTINCT p.domain, m.attr FROM prompts p,
    (SELECT unnest(['upsample', 'eda'] || [g.engine || '_' || g.temp FOR g IN {GRID_SQL}]) AS attr) m
)
SELECT * FROM plan WHERE (domain, attr) NOT IN (SELECT DISTINCT domain, attr FROM gen)""")
def q_aug17(spark, sf):
    c, p = prompts_of(spark, sf)
    modes = F.array(F.lit("upsample"), F.lit("eda"))
    plan = (p.select("domain").distinct().withColumn("attr", F.explode(modes))
            .unionByName(A.with_attr_grid(p.select("domain").distinct(), A.ENGINES, A.DEFAULT_TEMPS)
                         .select("domain", "attr"))
            .unionByName(A.with_attr_grid(p.select("domain").distinct(), ["gptj"], A.SWEEP_TEMPS)
                         .select("domain", "attr")))
    done = A.upsample(p, synthetic_quota(c))
    return A.resume(plan, done).distinct()


def echo(batch: pd.DataFrame) -> pd.DataFrame:
    """Built-in stand-in generator: request ``n`` texts, the prompt's seed lines in turn."""
    lines = {p: [ln.split(": ", 1)[1] for ln in p.split("\n")[1:-1]] for p in batch.prompt.unique()}
    n = batch.n.to_numpy(np.int64)
    at = np.repeat(np.arange(len(batch)), n)
    place = batch.req_idx.to_numpy(np.int64)[at] * A.N_MAX + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    seeds = [lines[p] for p in batch.prompt]
    text = [seeds[i][j % len(seeds[i])] for i, j in zip(at.tolist(), place.tolist(), strict=True)]
    return batch[A.REQUEST_KEY].iloc[at].reset_index(drop=True).assign(text=text)


def half_empty(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in that fails half its answers: every other text of a request is blank, from the first on or from the second."""
    out = echo(batch)
    choice = out.groupby(A.REQUEST_KEY).cumcount()
    out.loc[(choice + out.req_idx) % 2 == 0, "text"] = " \n"
    return out


@register("aug19_complete_hook", GEN + "SELECT domain, intent, intent_id, prompt_id, gen_idx, "
          + STRIP_SQL.format(x="text") + " AS text FROM gen WHERE " + STRIP_SQL.format(x="text") + " <> ''")
def q_aug19(spark, sf):
    c, p = prompts_of(spark, sf)
    req = A.plan_requests(p.join(synthetic_quota(c).withColumnRenamed("val_domain", "domain"), "domain"))
    return A.complete(req, A.each_batch(echo))


@register("aug13_complete_quota", GEN + """
SELECT g.domain, g.intent, g.intent_id, g.prompt_id, g.gen_idx, true AS of_prompt FROM gen g""")
def q_aug13q(spark, sf):
    """A generator that fails half its answers, asked until each prompt has its quota; the rows tell whether each text is a
    line of its prompt."""
    c, p = prompts_of(spark, sf)
    p = durable(p, "prompts")  # the corpus is sampled once, not again for the lines
    asked = p.join(synthetic_quota(c).withColumnRenamed("val_domain", "domain"), "domain")
    got = A.complete_quota(asked, "quota", A.each_batch(half_empty), n_max=4)
    seeds = F.transform("lines", py_strip)
    return got.join(p.select(*A.PROMPT_KEY, seeds.alias("lines")), A.PROMPT_KEY).select(
        "domain", "intent", "intent_id", "prompt_id", "gen_idx", F.array_contains("lines", F.col("text")).alias("of_prompt"))

