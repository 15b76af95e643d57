"""Registered soft-label mixing queries (MIX-*) with their oracles.

Completions are derived from all corpus rows (three choices per
row: a well-formed pair, a pair with an upper-cased label and trailing text,
and the bare text), with keyed token log-probabilities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shotweave.functions.rand import draw_sql, seed_columns, seeds_sql, stream_lists, stream_sql
from shotweave.functions.text import STRIP_SQL
from shotweave.operators import mix as X
from shotweave.operators.sample import few_shot_train
from shotweave.plans.catalog import register
from shotweave.plans.sqltext import K, SEEDS_SQL, with_corpus
from shotweave.session import MAX_CLASSES
from shotweave.sources.corpus import corpus
from shotweave.sources.tables import durable

LABS_SQL = ", labs AS (SELECT intent, intent_id FROM dim WHERE intent <> 'oos')"


def _labels(spark, sf):
    """The label dictionary, as the corpus has it."""
    return corpus(spark, sf).select("intent", "intent_id").distinct()


def _label_names(spark, sf):
    names = [r[0] for r in _labels(spark, sf).where(F.col("intent") != "oos").orderBy("intent_id")
             .limit(MAX_CLASSES + 1).collect()]
    if len(names) > MAX_CLASSES:
        raise ValueError("too many labels for a mixing prompt")
    return names


@register("mix01_mix_prompt", with_corpus(SEEDS_SQL) + LABS_SQL + f"""
, hdr AS (SELECT 'Each item in the following list contains a sentence and the respective intent. Intent is one of '
                 || string_agg('''' || lower(intent) || '''', ', or ' ORDER BY intent_id) || '.' || chr(10) AS h FROM labs)
, others AS (
  SELECT s.row_id, l.intent AS lbl,
         row_number() OVER (PARTITION BY s.row_id ORDER BY {draw_sql('mix', "'lbl'", 's.row_id', 'l.intent')}, l.intent) AS pos
  FROM seeds s JOIN labs l ON l.intent <> s.intent
  QUALIFY pos <= {K - 1}
), cnt AS (SELECT intent AS lbl, count(*) AS cnt FROM seeds GROUP BY intent)
, picks AS (
  SELECT o.row_id, o.pos, o.lbl, CAST(floor({draw_sql('mix', "'seed'", 'o.row_id', 'o.lbl')} * c.cnt) + 1 AS INTEGER) AS rn
  FROM others o JOIN cnt c USING (lbl))
, lines AS (
  SELECT p.row_id, p.pos, 'Sentence: ' || s.text || '. (intent: ' || p.lbl || ')' || chr(10) AS line
  FROM picks p JOIN seeds s ON s.intent = p.lbl AND s.rn = p.rn)
, body AS (SELECT row_id, string_agg(line, '' ORDER BY pos) AS others FROM lines GROUP BY row_id)
SELECT s.row_id, s.intent, s.intent_id,
       (SELECT h FROM hdr) || 'Sentence: ' || s.text || '. (intent: ' || s.intent || ')' || chr(10)
       || coalesce(b.others, '') || 'Sentence:' AS prompt
FROM seeds s LEFT JOIN body b USING (row_id)""")
def q_mix01(spark, sf):
    c = corpus(spark, sf)
    return X.mix_prompts(few_shot_train(c, K), _label_names(spark, sf), K)


COMP_SQL = with_corpus() + LABS_SQL + f"""
, comp AS (
  SELECT row_id AS request_id, CAST(j AS INTEGER) AS choice_idx,
         CASE j WHEN 0 THEN ' ' || text || '. (intent: ' || intent || ')'
                WHEN 1 THEN ' ' || text || '. (intent: ' || upper(intent) || ') and more'
                ELSE text END AS text
  FROM corpus, LATERAL (SELECT unnest(range(3)) AS j) x
), parsed AS (
  SELECT *,
    CASE WHEN regexp_matches('Sentence:' || text, '{X.PAIR_PATTERN}')
         THEN lower({STRIP_SQL.format(x="regexp_extract('Sentence:' || text, '" + X.PAIR_PATTERN + "', 1)")}) END AS gen_text,
    CASE WHEN regexp_matches('Sentence:' || text, '{X.PAIR_PATTERN}')
         THEN lower({STRIP_SQL.format(x="regexp_extract('Sentence:' || text, '" + X.PAIR_PATTERN + "', 2)")}) END AS pred_label
  FROM comp
), toks AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z\\s]') AS tokens FROM parsed
  WHERE gen_text IS NOT NULL AND gen_text <> ''
), probs AS (
  SELECT *, list_transform(tokens, lambda t, i: -{stream_sql('i - 1')}) AS token_logprobs
  FROM (SELECT *, {seeds_sql("'lp'", "request_id", "choice_idx")} FROM toks) t
), labelled AS (
  SELECT request_id, choice_idx, gen_text, pred_label,
         CASE WHEN list_position(tokens, ')') > 0
              THEN exp(list_sum(token_logprobs[1:list_position(tokens, ')') - 1]) + 0.0) END AS prob
  FROM probs
), votes AS (
  SELECT l.request_id AS row_key, b.intent_id AS label_id, l.prob
  FROM labelled l JOIN labs b ON lower(b.intent) = l.pred_label WHERE l.prob IS NOT NULL
), norm AS (
  SELECT row_key, label_id, p / sum(p) OVER (PARTITION BY row_key) AS p
  FROM (SELECT row_key, label_id, avg(prob) AS p FROM votes GROUP BY ALL) t
)
"""


def completions(spark, sf):
    c = corpus(spark, sf)
    j = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("choice_idx")
    comp = c.select(F.col("row_id").alias("request_id"), "text", "intent", j)
    text = (F.when(F.col("choice_idx") == 0,
                   F.concat(F.lit(" "), "text", F.lit(". (intent: "), "intent", F.lit(")")))
            .when(F.col("choice_idx") == 1,
                  F.concat(F.lit(" "), "text", F.lit(". (intent: "), F.upper("intent"), F.lit(") and more")))
            .otherwise(F.col("text")))
    return comp.select("request_id", "choice_idx", text.alias("text"))


def labelled_completions(spark, sf):
    p = X.parsed_completions(completions(spark, sf))
    s1, s2 = seed_columns("lp", F.col("request_id"), F.col("choice_idx"))
    toks = X.computed(p, tokens=F.regexp_extract_all("text", F.lit("[A-Za-z]+|[^A-Za-z\\s]"), 0), _s1=s1, _s2=s2)
    draws = stream_lists(F.col("_s1"), F.col("_s2"), F.size("tokens"))
    toks = X.computed(toks.withColumn("_u", draws), token_logprobs=F.transform("_u", lambda u: -u)).drop("_u")
    return X.computed(toks, prob=X.label_probability(F.col("tokens"), F.col("token_logprobs")))


def _votes(spark, sf, lc=None):
    dim = _labels(spark, sf).where(F.col("intent") != "oos")
    lab = dim.select(F.lower("intent").alias("pred_label"), F.col("intent_id").alias("label_id"))
    lc = lc if lc is not None else labelled_completions(spark, sf)
    return (lc.join(lab, "pred_label").where(F.col("prob").isNotNull())
            .select(F.col("request_id").alias("row_key"), "label_id", "prob"))


@register("mix02_parse_pair", COMP_SQL + """
SELECT request_id, choice_idx, gen_text, pred_label FROM parsed WHERE gen_text IS NOT NULL AND gen_text <> ''""")
def q_mix02(spark, sf):
    return X.parsed_completions(completions(spark, sf)).select("request_id", "choice_idx", "gen_text", "pred_label")


@register("mix03_label_probability", COMP_SQL + "SELECT request_id, choice_idx, round(prob, 9) AS prob FROM labelled")
def q_mix03(spark, sf):
    return labelled_completions(spark, sf).select("request_id", "choice_idx", F.round("prob", 9).alias("prob"))


@register("mix04_normalise_votes", COMP_SQL + "SELECT row_key, label_id, round(p, 9) AS p FROM norm")
def q_mix04(spark, sf):
    return X.normalise_votes(_votes(spark, sf), label="label_id").select(
        "row_key", "label_id", F.round("p", 9).alias("p"))


N_SQL = "(SELECT count(*) FROM dim)"


@register("mix05_soft_label", COMP_SQL + f"""
, m AS (SELECT row_key, map_from_entries(list({{'key': label_id, 'value': p}})) AS m FROM norm GROUP BY row_key)
, rows AS (SELECT DISTINCT request_id AS row_key FROM comp)
SELECT r.row_key, list_transform(range({N_SQL}), lambda i: round(coalesce(m.m[i], 0.0), 9)) AS label_vec
FROM rows r LEFT JOIN m USING (row_key)""")
def q_mix05(spark, sf):
    n = _labels(spark, sf).count()
    rows = completions(spark, sf).select(F.col("request_id").alias("row_key")).distinct()
    probs = X.normalise_votes(_votes(spark, sf), label="label_id")
    out = X.soft_labels(rows, probs, n)
    return out.select("row_key", F.transform("label_vec", lambda x: F.round(x, 9)).alias("label_vec"))


MIXED_SQL = COMP_SQL + SEEDS_SQL.format(k=K) + f"""
, m AS (SELECT row_key, map_from_entries(list({{'key': label_id, 'value': p}})) AS m FROM norm GROUP BY row_key)
, soft AS (SELECT row_key, list_transform(range({N_SQL}), lambda i: round(coalesce(m.m[i], 0.0), 9)) AS label_vec FROM m)
, mixed AS (
  SELECT 'gold' AS origin, text, list_transform(range({N_SQL}), lambda i: CASE WHEN i = intent_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS label_vec FROM seeds
  UNION ALL
  SELECT 'mixed', l.gen_text, s.label_vec FROM labelled l JOIN soft s ON s.row_key = l.request_id
  UNION ALL
  SELECT 'oos', text, list_transform(range({N_SQL}), lambda i: CASE WHEN i = intent_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
  FROM corpus WHERE intent = 'oos' AND split = 'train'
)
"""


@register("mix06_mix_dataset", MIXED_SQL + "SELECT * FROM mixed")
def q_mix06(spark, sf):
    c = corpus(spark, sf)
    n = _labels(spark, sf).count()
    # parsed once: the votes and the rows that they label both read the written table
    lc = durable(labelled_completions(spark, sf).select(F.col("request_id").alias("row_key"), F.col("request_id"), F.col("gen_text").alias("text"),
                                                        "pred_label", "prob"), "labelled")
    votes = X.normalise_votes(_votes(spark, sf, lc), label="label_id").withColumn("p", F.round("p", 9))
    mixed = X.soft_labels(lc.select("row_key", "text"), votes, n, voted_only=True)
    oos = c.where((F.col("intent") == "oos") & (F.col("split") == "train"))
    return X.mix_dataset(few_shot_train(c, K), mixed, oos, n)
