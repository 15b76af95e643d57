"""DuckDB SQL text shared by the oracle queries (the same rules as the Spark operators)."""

from shotweave.sources.corpus import CORPUS_SQL

K = 3  # seeds per class on the fixture corpus (in-scope train classes hold 1-28 rows)

SEEDS_SQL = """
, seeds AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY intent ORDER BY sha1(text), row_id) AS INTEGER) AS rn
  FROM corpus WHERE intent <> 'oos' AND split = 'train'
  QUALIFY rn <= {k}
)
"""

PROMPTS_SQL = """
, prompts AS (
  SELECT domain, intent, intent_id, CAST(floor((rn - 1) / {k}) AS INTEGER) AS prompt_id,
         list(text ORDER BY rn) AS lines,
         'The following sentences belong to the same category ''' || intent || ''':' || chr(10) ||
         string_agg('Example ' || CAST(((rn - 1) % {k}) + 1 AS VARCHAR) || ': ' || text, chr(10) ORDER BY rn)
         || chr(10) || 'Example {k1}:' AS prompt
  FROM seeds GROUP BY domain, intent, intent_id, prompt_id
)
"""

QUOTA_SQL = """
, sizes AS (
  SELECT intent, domain, count(*) AS cnt FROM corpus WHERE split = 'train' GROUP BY intent, domain
), doms AS (SELECT DISTINCT domain AS val_domain FROM sizes WHERE intent <> 'oos'),
quota AS (
  SELECT d.val_domain, CAST(floor(coalesce(
     (SELECT median(cnt) FROM sizes s WHERE s.intent <> 'oos' AND s.domain <> d.val_domain),
     (SELECT median(cnt) FROM sizes))) AS BIGINT) AS quota
  FROM doms d
)
"""

UPSAMPLE_SQL = """
, gen AS (
  SELECT p.domain, 'upsample' AS attr, p.intent, p.intent_id, p.prompt_id, CAST(g.i AS BIGINT) AS gen_idx,
         p.lines[(g.i % len(p.lines)) + 1] AS text
  FROM prompts p JOIN quota q ON p.domain = q.val_domain,
       LATERAL (SELECT unnest(range(q.quota)) AS i) g
)
"""

NB_SQL = """
, train_tok AS (
  SELECT intent_id, intent, regexp_extract_all(lower(text), '[a-z]+') AS tokens
  FROM corpus WHERE split = 'train'
), tok_counts AS (
  SELECT token, intent_id, count(*) AS cnt
  FROM (SELECT intent_id, unnest(tokens) AS token FROM train_tok) t GROUP BY token, intent_id
), stats AS (
  SELECT intent_id, intent, ln(count(*) / (SELECT count(*) FROM train_tok)) AS lp,
         ln(sum(len(tokens)) + (SELECT count(DISTINCT token) FROM tok_counts)) AS ld
  FROM train_tok GROUP BY intent_id, intent
), pool_tok AS (
  SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS tokens FROM pool
), seen AS (
  SELECT row_key, intent_id, sum(CAST(round(ln(cnt + 1.0) * 1e9) AS BIGINT)) AS s
  FROM (SELECT row_key, unnest(tokens) AS token FROM pool_tok) t JOIN tok_counts USING (token)
  GROUP BY row_key, intent_id
), scores AS (
  SELECT p.row_key, st.intent_id, st.intent,
         CAST(CAST(round(st.lp * 1e9) AS BIGINT) - len(p.tokens) * CAST(round(st.ld * 1e9) AS BIGINT)
              + coalesce(se.s, 0) AS DOUBLE) / 1e9 AS score
  FROM pool_tok p CROSS JOIN stats st
  LEFT JOIN seen se ON se.row_key = p.row_key AND se.intent_id = st.intent_id
), pred AS (
  SELECT row_key, intent_id AS pred_id, intent AS pred FROM (
    SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY score DESC, intent_id) AS r FROM scores) x
  WHERE r = 1
), relabelled AS (
  SELECT p.attr, p.row_key, p.text, p.old_intent_id, p.old_intent,
         CAST(pr.pred_id AS INTEGER) AS intent_id, pr.pred AS intent
  FROM pool p JOIN pred pr USING (row_key)
)
"""

POOL_SQL = """
, pool AS (
  SELECT attr, attr || ':' || domain || ':' || intent || ':' || CAST(prompt_id AS VARCHAR) || ':'
         || CAST(gen_idx AS VARCHAR) AS row_key, text, intent_id AS old_intent_id, intent AS old_intent
  FROM gen WHERE domain <> 'oos'
  UNION ALL
  SELECT split, split || ':' || CAST(row_id AS VARCHAR), text, intent_id, intent
  FROM corpus WHERE split IN ('val', 'test')
)
"""


def with_corpus(*parts: str, k: int = K) -> str:
    return CORPUS_SQL + "".join(p.format(k=k, k1=k + 1) for p in parts)


def dom_sql(x: str) -> str:
    return f"CASE WHEN {x} = 'oos' THEN 'oos' ELSE split_part({x}, '_', 1) END"


FLAGSHIP_SQL = with_corpus(SEEDS_SQL, PROMPTS_SQL, QUOTA_SQL, UPSAMPLE_SQL, POOL_SQL, NB_SQL) + f"""
SELECT CASE WHEN attr = 'val' THEN 'threshold' ELSE attr END AS attr, domain,
       round(avg(CASE WHEN intent_id = old_intent_id THEN 1.0 ELSE 0.0 END), 6) AS fidelity,
       round(avg(CASE WHEN {dom_sql('intent')} = domain THEN 1.0 ELSE 0.0 END), 6) AS domain_fidelity,
       count(*) AS n_rows
FROM (SELECT *, {dom_sql('old_intent')} AS domain FROM relabelled) r
GROUP BY ROLLUP (CASE WHEN attr = 'val' THEN 'threshold' ELSE attr END, domain)
HAVING CASE WHEN attr = 'val' THEN 'threshold' ELSE attr END IS NOT NULL
"""
