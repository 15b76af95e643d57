"""The queries ``op1_*`` to ``op13_*`` over whole tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.common import table

TOXIC_FROM = 0.3
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MIN_SITES = 10


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.pseudo_lm import pseudo_likelihood
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.balltree import top_k
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.paragraphs import paragraph_dedup
    return paragraph_dedup(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.parity_join import ngram_jaccard_join
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.chat_repair import repair_chats
    return repair_chats(table(spark, sf_dir, "conversations"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, score, passages`` by a model of the labelled rows that aren't held out."""
    from shotweave.llm.toxic_segments import fit_segments, held_out, score_toxicity
    labels = table(spark, sf_dir, "labels")
    return score_toxicity(docs, fit_segments(docs, labels.where(~held_out("doc_id"))))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.toxic_segments import held_out
    return toxicity(spark, table(spark, sf_dir, "documents"), sf_dir).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.decontaminate import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.site_lines import remove_site_lines
    return remove_site_lines(table(spark, sf_dir, "documents"), MIN_SITES, counts=True).select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.md5("text").alias("text_md5"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.url_rules import match_rules
    return match_rules(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.fim import fill_in_middle, restore
    rows = restore(fill_in_middle(table(spark, sf_dir, "documents")), to="restored")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.whitening import fit_whitening, whiten
    vectors = table(spark, sf_dir, "embeddings")
    model = fit_whitening(vectors, components=16)
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    n, explained, error = (model.n, model.explained.tolist(), model.identity_error) if model else (0, [], None)
    share = F.array([F.lit(v) for v in explained]) if explained else F.array().cast("array<double>")
    return rows.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotweave.llm.run_index import remove_repeats
    rows = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudo_likelihood": op1, "op2_ball_tree_top_k": op2, "op3_paragraph_dedup": op3, "op4_ngram_jaccard": op4,
    "op5_role_repair": op5, "op6_toxic_segments": op6, "op7_packing": op7, "op8_decontamination": op8,
    "op9_site_lines": op9, "op10_url_rules": op10, "op11_fill_in_middle": op11, "op12_whitening": op12,
    "op13_run_index": op13}

#: Lower-casing of A-Z only.
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
  FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""

OP9_SQL = f"""
WITH l AS (
  SELECT source, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM documents
), wide AS (
  SELECT line FROM l WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), d AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), p AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d
), k AS (
  SELECT p.r, count(w.line) AS gone, coalesce(string_agg(p.line, chr(10) ORDER BY p.i) FILTER (WHERE w.line IS NULL), '') AS kept
  FROM p LEFT JOIN wide w ON trim(p.line, ' ' || chr(9) || chr(13)) = w.line GROUP BY p.r
)
SELECT d.doc_id, CAST(CASE WHEN length(d.text) > 0 THEN len(string_split(d.text, chr(10))) ELSE 0 END AS BIGINT) AS n_lines,
       CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, md5(CASE WHEN d.text IS NULL THEN NULL ELSE k.kept END) AS text_md5
FROM d LEFT JOIN k ON d.r = k.r
"""

OP10_SQL = f"""
WITH r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (
  SELECT page_id, row_number() OVER () AS k, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), s AS (
  SELECT page_id, k, {_AZ.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT s.k, arg_max(r.h || r.p, length(r.h) * 1000 + length(r.p)) AS rule, arg_max(r.v, length(r.h) * 1000 + length(r.p)) AS v
  FROM s JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p) GROUP BY s.k
)
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM s LEFT JOIN m ON s.k = m.k
"""

#: Sets, links and classes; the recursion follows links to the smallest id.
OP4_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_AZ.format("text")}, '[ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS g FROM w
), n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
sets AS (SELECT list_sort(g) AS k, min(doc_id) AS rep FROM s WHERE len(g) > 0 GROUP BY 1),
same AS (SELECT s.doc_id, t.rep FROM s JOIN sets t ON list_sort(s.g) = t.k),
e AS (SELECT rep AS doc_id, unnest(k) AS x, len(k) AS n FROM sets),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * i >= 75 * (na + nb - i)),
near AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT rep, rep FROM sets UNION SELECT r.a, t.b FROM reach r JOIN near t ON r.b = t.a),
label AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(label.component_id, n.doc_id) AS component_id
FROM n LEFT JOIN same USING (doc_id) LEFT JOIN label USING (rep)
"""

OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), n AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n
), c AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

ORACLE: dict[str, str] = {"op2_ball_tree_top_k": OP2_SQL, "op4_ngram_jaccard": OP4_SQL, "op9_site_lines": OP9_SQL,
                          "op10_url_rules": OP10_SQL, "op11_fill_in_middle": OP11_SQL}
