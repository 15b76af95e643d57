"""Registered review-table queries (REP-*) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotweave.operators import review as V
from shotweave.operators.sample import few_shot_train
from shotweave.plans.catalog import register
from shotweave.plans.flagship import upsample_relabelled
from shotweave.plans.sqltext import K, NB_SQL, POOL_SQL, PROMPTS_SQL, QUOTA_SQL, SEEDS_SQL, UPSAMPLE_SQL, with_corpus
from shotweave.functions.rand import draw_sql
from shotweave.sources.corpus import corpus

REL = with_corpus(SEEDS_SQL, PROMPTS_SQL, QUOTA_SQL, UPSAMPLE_SQL, POOL_SQL, NB_SQL)
ROWS_SQL = REL + """
, sheets AS (SELECT DISTINCT domain, intent FROM seeds)
, rrows AS (
  SELECT 'upsample' AS attr, domain || '<>' || replace(intent, '?', '') AS sheet, 'prompt' AS kind, text,
         NULL::VARCHAR AS oracle_prediction, CAST(row_id AS VARCHAR) AS row_key FROM seeds
  UNION ALL
  SELECT r.attr, s.domain || '<>' || replace(r.old_intent, '?', ''), 'generated', r.text,
         replace(r.intent, '?', ''), r.row_key
  FROM relabelled r JOIN sheets s ON s.intent = r.old_intent WHERE r.attr = 'upsample'
)
"""


def _rows(spark, sf):
    c = corpus(spark, sf)
    rel = upsample_relabelled(spark, sf, K).where(F.col("attr") == "upsample")
    return V.review_rows(few_shot_train(c, K), rel)


@register("rep01_review_rows", ROWS_SQL + "SELECT * FROM rrows")
def q_rep01(spark, sf):
    return _rows(spark, sf)


@register("rep02_sheet_stats", ROWS_SQL + """
SELECT attr, sheet, count(*) FILTER (WHERE kind = 'generated' AND oracle_prediction = split_part(sheet, '<>', 2)) AS faithful,
       count(*) FILTER (WHERE kind = 'generated') AS generated, CAST(max(length(text)) AS INTEGER) AS max_text_len,
       CAST(max(length(oracle_prediction)) AS INTEGER) AS max_pred_len,
       CAST(count(*) FILTER (WHERE kind = 'generated' AND oracle_prediction = split_part(sheet, '<>', 2)) AS VARCHAR)
         || '/' || CAST(count(*) FILTER (WHERE kind = 'generated') AS VARCHAR) AS ratio,
       CASE WHEN count(*) FILTER (WHERE kind = 'generated') > 0 THEN round(100.0 *
         count(*) FILTER (WHERE kind = 'generated' AND oracle_prediction = split_part(sheet, '<>', 2))
         / count(*) FILTER (WHERE kind = 'generated'), 2) END AS pct
FROM rrows GROUP BY attr, sheet""")
def q_rep02(spark, sf):
    return V.sheet_stats(_rows(spark, sf))


@register("rep03_shown_generators", REL + """
SELECT DISTINCT attr FROM (SELECT attr FROM relabelled UNION ALL SELECT 'gptj_' || t FROM (SELECT unnest(['0.5', '1.0', '2.0']) AS t) x) a
WHERE NOT contains(attr, '_') OR split_part(attr, '_', 2) = '1.0'""")
def q_rep03(spark, sf):
    rel = upsample_relabelled(spark, sf, K).select("attr")
    sweep = rel.select(F.explode(F.array(*[F.lit(f"gptj_{t}") for t in ("0.5", "1.0", "2.0")])).alias("attr"))
    return V.shown_generators(rel.unionByName(sweep)).distinct()


BLIND_INTENTS_SQL = "(SELECT intent FROM corpus WHERE intent <> 'oos' GROUP BY intent ORDER BY count(*) DESC, intent LIMIT 3)"
BLIND_SQL = with_corpus() + f"""
, blind AS (
  SELECT CAST(row_number() OVER (ORDER BY {draw_sql('blind', 'row_id')}, row_id) AS BIGINT) AS line_no, text, intent AS label
  FROM corpus WHERE intent IN {BLIND_INTENTS_SQL}
)
"""


def _blind(spark, sf):
    c = corpus(spark, sf)
    top = (c.where(F.col("intent") != "oos").groupBy("intent").count()
           .orderBy(F.desc("count"), "intent").limit(3))
    return c, V.blind_sheet(c, top)


@register("rep04_blind_sheet", BLIND_SQL + "SELECT * FROM blind")
def q_rep04(spark, sf):
    return _blind(spark, sf)[1]


@register("rep05_score_annotator", BLIND_SQL + """
, codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) AS VARCHAR) AS code FROM (SELECT DISTINCT label FROM blind) t),
answers AS (
  SELECT b.line_no, CASE WHEN b.line_no % 3 = 0 THEN c2.code ELSE c.code END AS code
  FROM blind b JOIN codes c ON c.label = b.label
  JOIN codes c2 ON c2.code = CAST(((CAST(c.code AS INTEGER)) % 3) + 1 AS VARCHAR)
), j AS (SELECT a.line_no, c.label AS pred, b.label FROM answers a JOIN blind b USING (line_no) JOIN codes c ON c.code = a.code)
SELECT label, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_rows
FROM j GROUP BY ROLLUP (label)""")
def q_rep05(spark, sf):
    _, b = _blind(spark, sf)
    labels = [r[0] for r in b.select("label").distinct().orderBy("label").collect()]  # at most 3 names
    code_map = {str(i + 1): lbl for i, lbl in enumerate(labels)}
    inv = F.create_map(*[x for k, v in code_map.items() for x in (F.lit(v), F.lit(k))])
    true_code = inv[F.col("label")].cast("int")
    # a stand-in annotator: right on two lines of three, the next code on every third line
    code = F.when(F.col("line_no") % 3 == 0, ((true_code % len(labels)) + 1).cast("string")) \
        .otherwise(true_code.cast("string"))
    answers = b.select("line_no", code.alias("code"))
    return V.score_annotator(answers, b.select("line_no", "label"), code_map)
