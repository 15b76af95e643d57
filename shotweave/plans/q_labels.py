"""Registered label, split and sampling queries (LBL-*, FS-*) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotweave.functions.rand import draw, draw_sql
from shotweave.operators import labels as L
from shotweave.operators import sample as S
from shotweave.plans.catalog import register
from shotweave.plans.sqltext import K, SEEDS_SQL, with_corpus
from shotweave.sources.corpus import base_rows, corpus

C = with_corpus()


@register("src_corpus", C + "SELECT * FROM corpus")
def q_corpus(spark, sf):
    return corpus(spark, sf)


@register("lbl01_label_dictionary", C + "SELECT * FROM dim")
def q_lbl01(spark, sf):
    return L.label_dictionary(base_rows(spark, sf))


@register("lbl03_encode_labels", C + "SELECT b.row_id, b.intent, d.intent_id FROM base b JOIN dim d USING (intent)")
def q_lbl03(spark, sf):
    rows = base_rows(spark, sf)
    return L.encode_labels(rows, L.label_dictionary(rows)).select("row_id", "intent", "intent_id")


@register("lbl04_decode_labels", C + """
SELECT c.row_id, c.intent_id, d.intent AS intent_name FROM corpus c LEFT JOIN dim d USING (intent_id)""")
def q_lbl04(spark, sf):
    rows = base_rows(spark, sf)
    dim = L.label_dictionary(rows)
    c = corpus(spark, sf).select("row_id", "intent_id")
    return L.decode_labels(c, dim, name_col="intent_name").select("row_id", "intent_id", "intent_name")


ROUTE_KEY_SQL = ("(CASE WHEN intent = 'oos' THEN 'oos_' ELSE '' END || "
                 "CASE WHEN split = 'val' AND row_id % 2 = 0 THEN 'valid' ELSE split END)")


@register("lbl05_route_split", C + f"""
SELECT split_key, CASE WHEN contains(split_key, 'train') THEN 'train'
                       WHEN contains(split_key, 'val') THEN 'val' ELSE 'test' END AS routed,
       count(*) AS n_rows
FROM (SELECT {ROUTE_KEY_SQL} AS split_key FROM corpus) t GROUP BY ALL""")
def q_lbl05(spark, sf):
    c = corpus(spark, sf)
    key = F.concat(F.when(F.col("intent") == "oos", "oos_").otherwise(""),
                   F.when((F.col("split") == "val") & (F.col("row_id") % 2 == 0), "valid")
                   .otherwise(F.col("split")))
    return (c.select(key.alias("split_key")).withColumn("routed", L.route_split(F.col("split_key")))
            .groupBy("split_key", "routed").agg(F.count(F.lit(1)).alias("n_rows")))


@register("lbl07_prefix_domain", C + "SELECT DISTINCT intent, domain FROM corpus")
def q_lbl07(spark, sf):
    return corpus(spark, sf).select("intent", L.prefix_domain(F.col("intent")).alias("domain")).distinct()


@register("lbl09_intent_domain", C + """
, dmap AS (
  SELECT DISTINCT domain, intent, intent_id AS pos FROM corpus
  UNION ALL
  SELECT DISTINCT split_part(intent, '_', 2), intent, 100000 + intent_id FROM corpus WHERE intent <> 'oos'
)
SELECT intent, domain FROM (
  SELECT *, row_number() OVER (PARTITION BY intent ORDER BY pos) AS rn FROM dmap) t WHERE rn = 1""")
def q_lbl09(spark, sf):
    c = corpus(spark, sf)
    first = c.select("domain", "intent", F.col("intent_id").alias("pos")).distinct()
    second = (c.where(F.col("intent") != "oos")
              .select(F.split_part(F.col("intent"), F.lit("_"), F.lit(2)).alias("domain"), "intent",
                      (F.lit(100000) + F.col("intent_id")).alias("pos")).distinct())
    return L.intent_domain(first.unionByName(second))


@register("lbl10_group_by_intent", C + "SELECT split, intent, row_id, text FROM corpus")
def q_lbl10(spark, sf):
    return L.group_by_intent(corpus(spark, sf))


@register("lbl11_stratified_split", C + f"""
SELECT row_id, intent, CASE WHEN rn <= q THEN 'train' ELSE 'val' END AS split FROM (
  SELECT row_id, intent,
         row_number() OVER (PARTITION BY intent ORDER BY {draw_sql('split', 'row_id')}, row_id) AS rn,
         round(count(*) OVER (PARTITION BY intent) * 0.9) AS q
  FROM corpus) t""")
def q_lbl11(spark, sf):
    c = corpus(spark, sf).select("row_id", "intent")
    return L.stratified_split(c, 0.9).select("row_id", "intent", "split")


@register("lbl12_split_sizes", C + """
SELECT split, count(*) AS n_rows, count(DISTINCT intent) AS n_intents FROM corpus GROUP BY split""")
def q_lbl12(spark, sf):
    return L.split_sizes(corpus(spark, sf))


@register("lbl13_sheet_key", C + """
SELECT row_id, domain || '<>' || replace(intent, '?', '') || '<>' || replace(text, '?', '') AS sheet_key FROM corpus""")
def q_lbl13(spark, sf):
    c = corpus(spark, sf)
    return c.select("row_id", F.concat_ws("<>", "domain", L.sheet_key(F.col("intent")),
                                          L.sheet_key(F.col("text"))).alias("sheet_key"))


@register("lbl14_one_hot", C + """
SELECT row_id, list_transform(range((SELECT count(*) FROM dim)),
                              lambda i: CASE WHEN i = intent_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS label_vec
FROM corpus""")
def q_lbl14(spark, sf):
    c = corpus(spark, sf)
    n = L.label_dictionary(base_rows(spark, sf)).select(F.count(F.lit(1))).scalar()
    return L.with_one_hot(c.withColumn("_n", n), F.col("_n")).select("row_id", "label_vec")


@register("lbl15_seq2seq_format", C + """
SELECT row_id, text || ' </s>' AS text, intent || ' </s>' AS target FROM corpus""")
def q_lbl15(spark, sf):
    return L.seq2seq_format(corpus(spark, sf))


OOS_ID_SQL = "(SELECT intent_id FROM dim WHERE intent = 'oos')"


def _oos_id(spark, sf):
    return (L.label_dictionary(base_rows(spark, sf)).where(F.col("intent") == "oos")
            .select(F.max("intent_id")).scalar())


@register("lbl16_filter_oos", C + f"SELECT row_id, intent_id, split FROM corpus WHERE intent_id <> {OOS_ID_SQL}")
def q_lbl16(spark, sf):
    c = corpus(spark, sf)
    return L.filter_oos(c, _oos_id(spark, sf)).select("row_id", "intent_id", "split")


@register("lbl17_filter_oos_soft", """
SELECT vec_id, label FROM embeddings
WHERE list_position(embedding, list_max(embedding)) - 1 <> 9""")
def q_lbl17(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    e = e.withColumn("label_vec", F.col("embedding"))
    return L.filter_oos_soft(e, 9).select("vec_id", "label")


@register("lbl18_extract_oos", C + f"SELECT row_id, text, split FROM corpus WHERE intent_id = {OOS_ID_SQL}")
def q_lbl18(spark, sf):
    c = corpus(spark, sf)
    return L.extract_oos(c, _oos_id(spark, sf)).select("row_id", "text", "split")


@register("lbl19_keep_intents", C + """
SELECT row_id, intent FROM corpus WHERE split = 'train'
  AND intent IN (SELECT intent FROM corpus WHERE split = 'val')""")
def q_lbl19(spark, sf):
    c = corpus(spark, sf)
    return L.keep_intents(c.where(F.col("split") == "train"), c.where(F.col("split") == "val")) \
        .select("row_id", "intent")


# ---------------------------------------------------------------------------- FS
SEEDS = with_corpus(SEEDS_SQL)


@register("fs01_hash_topk", SEEDS + "SELECT row_id, intent, rn FROM seeds")
def q_fs01(spark, sf):
    c = S.in_scope(corpus(spark, sf)).where(F.col("split") == "train")
    return S.hash_topk(c, K).select("row_id", "intent", "rn")


@register("fs02_many_shot", C + """
SELECT 'en' AS val_domain, 'M' AS part, split, row_id, intent_id FROM corpus
WHERE intent <> 'oos' AND domain <> 'en'""")
def q_fs02(spark, sf):
    return S.many_shot(corpus(spark, sf), "en").select("val_domain", "part", "split", "row_id", "intent_id")


F_SQL = """
, fside AS (
  SELECT domain AS val_domain, 'F' AS part, split, row_id, intent_id FROM seeds
  UNION ALL
  SELECT domain, 'F', split, row_id, intent_id FROM corpus WHERE intent <> 'oos' AND split <> 'train'
)
"""


@register("fs03_few_shot", SEEDS + F_SQL + "SELECT * FROM fside")
def q_fs03(spark, sf):
    return S.few_shot(corpus(spark, sf), K).select("val_domain", "part", "split", "row_id", "intent_id")


@register("fs04_leave_one_domain_out", SEEDS + F_SQL + """
, doms AS (SELECT DISTINCT domain AS val_domain FROM corpus WHERE intent <> 'oos')
SELECT d.val_domain, 'M' AS part, c.split, c.row_id, c.intent_id
FROM corpus c JOIN doms d ON c.domain <> d.val_domain WHERE c.intent <> 'oos'
UNION ALL SELECT * FROM fside""")
def q_fs04(spark, sf):
    return S.leave_one_domain_out(corpus(spark, sf), K).select(
        "val_domain", "part", "split", "row_id", "intent_id")


@register("fs05_synthetic_quota", with_corpus("""
, sizes AS (SELECT intent, domain, count(*) AS cnt FROM corpus WHERE split = 'train' GROUP BY ALL),
doms AS (SELECT DISTINCT domain AS val_domain FROM sizes WHERE intent <> 'oos')
SELECT d.val_domain, CAST(floor(coalesce(
   (SELECT median(cnt) FROM sizes s WHERE s.intent <> 'oos' AND s.domain <> d.val_domain),
   (SELECT median(cnt) FROM sizes))) AS BIGINT) AS quota
FROM doms d"""))
def q_fs05(spark, sf):
    return S.synthetic_quota(corpus(spark, sf))


@register("fs06_seed_rows", SEEDS + """
SELECT row_id, intent, text FROM seeds WHERE intent IN (SELECT DISTINCT intent FROM corpus WHERE domain = 'de')""")
def q_fs06(spark, sf):
    c = corpus(spark, sf)
    return S.seed_rows(S.few_shot_train(c, K), c.where(F.col("domain") == "de")).select("row_id", "intent", "text")


@register("fs07_keyed_shuffle", C + f"SELECT row_id, {draw_sql('shuffle', 'row_id')} AS shuffle_key FROM corpus")
def q_fs07(spark, sf):
    return S.keyed_shuffle(corpus(spark, sf)).select("row_id", "shuffle_key")


_ = draw  # re-exported for callers building their own keyed orders


@register("lbl02_label_list", C + """
SELECT intent, CAST(row_number() OVER (ORDER BY n DESC, intent) - 1 AS INTEGER) AS intent_id
FROM (SELECT intent, count(*) AS n FROM corpus GROUP BY intent) t""")
def q_lbl02(spark, sf):
    return L.label_dictionary_in_order(corpus(spark, sf).groupBy("intent").count().orderBy(F.desc("count"), "intent"))


@register("lbl06_domain_map_rows", C + """
SELECT domain, intent, CAST(row_number() OVER (ORDER BY domain, intent) - 1 AS INTEGER) AS pos
FROM (SELECT DISTINCT domain, intent FROM corpus) t""")
def q_lbl06(spark, sf):
    return L.domain_map_in_order(corpus(spark, sf).select("domain", "intent").distinct().orderBy("domain", "intent"))


@register("lbl08_single_domain", C + "SELECT row_id, 'banking' AS domain FROM corpus")
def q_lbl08(spark, sf):
    return corpus(spark, sf).select("row_id", L.single_domain("banking").alias("domain"))
