"""Registered source, sink and streaming queries (SRC-*, SNK-*, STR-01).

Each query first writes data that Spark derives from the given tables into a
fresh folder under the session's checkpoint directory, in the format the
reader expects, then reads it back with the reader under test.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.functions.text import STRIP_SQL
from shotweave.operators.augment import spread
from shotweave.operators.labels import label_dictionary
from shotweave.operators.score import fit_scorer, relabel
from shotweave.plans.catalog import register
from shotweave.plans.flagship import corpus_scorer
from shotweave.plans.q_results import RUNS_SQL, run_tables
from shotweave.plans.q_score import RELABELLED, _pool
from shotweave.plans.sqltext import K, with_corpus
from shotweave.sources import readers as RD
from shotweave.sources import sinks as SK
from shotweave.sources.corpus import base_rows, corpus
from shotweave.sources.tables import task_folder, write_files, write_small
from shotweave.streaming.incremental import incremental, read_sink, scratch_path

KEY_SQL = "CASE WHEN intent = 'oos' THEN 'oos_' ELSE '' END || split"


def _keyed(c):
    return c.select(F.concat(F.when(F.col("intent") == "oos", "oos_").otherwise(""), F.col("split"))
                    .alias("split_key"), "text", "intent")


@register("src01_read_split_jsonl", with_corpus() + f"""
SELECT {KEY_SQL} AS split_key, text, intent, split FROM corpus""")
def q_src01(spark, sf):
    path = scratch_path(spark, "split-jsonl")
    _keyed(corpus(spark, sf)).write.json(path)
    return RD.read_split_jsonl(spark, path).select("split_key", "text", "intent", "split")


@register("src01_read_split_json", with_corpus() + f"""
SELECT {KEY_SQL} AS split_key, text, intent, split FROM corpus""")
def q_src01s(spark, sf):
    """Files of one JSON object each, {split key: [[text, intent], ...]}, of a few hundred rows."""
    path = scratch_path(spark, "split-json")
    pairs = _keyed(corpus(spark, sf)).withColumn("_file", F.pmod(F.xxhash64("text"), F.lit(64)))
    objects = pairs.groupBy("_file", "split_key").agg(F.collect_list(F.array("text", "intent")).alias("pairs"))
    text = F.to_json(F.map_from_arrays(F.array("split_key"), F.array("pairs")))
    objects.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return RD.read_split_json(spark, path).select("split_key", "text", "intent", "split")


@register("src02_read_parallel_lines", with_corpus() + """
SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS line_no, """ + STRIP_SQL.format(x="text") + """ AS text, intent
FROM corpus""")
def q_src02(spark, sf):
    c = corpus(spark, sf).orderBy("row_id")
    tp, lp = scratch_path(spark, "seq-in"), scratch_path(spark, "label")
    c.select("text").write.text(tp)
    c.select("intent").write.text(lp)
    return RD.read_parallel_lines(spark, tp + "/part-*", lp + "/part-*")


@register("src03_read_labelled_csv", with_corpus() + "SELECT text, intent FROM corpus")
def q_src03(spark, sf):
    path = scratch_path(spark, "csv")
    corpus(spark, sf).select("text", F.col("intent").alias("category")).write.option("header", True).csv(path)
    return RD.read_labelled_csv(spark, path)


@register("src04_read_columnar", with_corpus() + "SELECT text, intent_id AS intent FROM corpus")
def q_src04(spark, sf):
    path = scratch_path(spark, "columnar")
    corpus(spark, sf).select("text", F.col("intent_id").alias("label")).write.parquet(path)
    return RD.read_columnar(spark, path)


@register("src05_load_dataset", with_corpus() + "SELECT text, intent FROM corpus")
def q_src05(spark, sf):
    path = scratch_path(spark, "hwu")
    corpus(spark, sf).select("text", F.col("intent").alias("category")).write.option("header", True).csv(path)
    return RD.load_dataset(spark, "hwu64", path)


@register("src06_read_generic", with_corpus() + "SELECT row_id, text FROM corpus")
def q_src06(spark, sf):
    path = scratch_path(spark, "orc")
    corpus(spark, sf).select("row_id", "text").write.orc(path)
    return RD.read_generic(spark, path, "orc", schema="row_id long, text string")


@register("src07_label_map", with_corpus() + "SELECT intent, intent_id FROM dim")
def q_src07(spark, sf):
    path = scratch_path(spark, "name2id")
    RD.write_label_map(label_dictionary(base_rows(spark, sf)), path)
    return RD.read_label_map(spark, path)


def _run_files(r) -> list[tuple[str, str]]:
    """The files of a run folder, as (name, text): a few KB."""
    exp = {"dataset": {"name": r["dataset"], "config": r["config"], "oos_id": r["oos_id"]},
           "exp_type": r["exp_type"], "gpt3_engine": r["engine"], "gpt3_temp": r["temp"], "run#": r["run"]}
    body: dict = {}
    for e in r["r"] or []:
        where = body if e["scope"] is None else body.setdefault(e["scope"], {})
        where[e["key"]] = e["value"]  # json writes NaN as NaN
    return [(f"{r['folder']}/exp_dict.json", json.dumps(exp)), (f"{r['folder']}/code/results.json", json.dumps({"cfg": body}))]


def _write_run_tree(spark, sf, root):
    runs, res = run_tables(spark, sf)
    res_j = (res.groupBy("folder").agg(F.collect_list(F.struct("scope", "key", "value")).alias("r")))
    rows = runs.join(res_j, "folder", "left")
    if folder := task_folder(spark, root):
        spread(rows, "folder").foreachPartition(lambda part: write_files(folder, (f for r in part for f in _run_files(r))))
    else:  # one by one through the Hadoop API: any file system that Spark knows
        for r in rows.toLocalIterator():
            for name, text in _run_files(r):
                write_small(spark, f"{root}/{name}", text)


@register("src08_read_run_tree", RUNS_SQL + """
SELECT r.folder, r.dataset, r.config, r.exp_type, r.run, x.scope, x.key, round(x.value, 9) AS value
FROM runs r JOIN res x USING (folder)""")
def q_src08(spark, sf):
    root = scratch_path(spark, "runs")
    _write_run_tree(spark, sf, root)
    ex, res = RD.read_run_tree(spark, root)
    return (ex.join(res, "folder").select("folder", "dataset", "config", "exp_type", "run", "scope", "key",
                                          F.round("value", 9).alias("value")))


@register("src10_read_tables", RELABELLED.split(", train_tok AS")[0] + """
SELECT attr, row_key, text, old_intent_id FROM pool WHERE attr = 'upsample'""")
def q_src10(spark, sf):
    path = scratch_path(spark, "pool")
    SK.write_table(_pool(spark, sf)[1], path, partition_by="attr")
    t = RD.read_table(spark, path, where="attr = 'upsample'")
    return t.select("attr", "row_key", "text", "old_intent_id")


SINK_SCHEMA = T.StructType([
    T.StructField("attr", T.StringType()), T.StructField("row_key", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("old_intent_id", T.IntegerType()),
    T.StructField("old_intent", T.StringType()), T.StructField("intent_id", T.IntegerType()),
    T.StructField("intent", T.StringType())])


@register("str01_incremental_relabel", RELABELLED + "SELECT attr, row_key, old_intent_id, intent_id, intent FROM relabelled")
def q_str01(spark, sf):
    c, pool = _pool(spark, sf)
    model = corpus_scorer(spark, sf)
    src, sink = scratch_path(spark, "stream-src"), scratch_path(spark, "stream-sink")
    # two arrivals: the generated rows, then the val/test pool
    pool.where(F.col("attr") == "upsample").write.parquet(src + "/batch=0")
    incremental(spark, src, pool.schema, sink, lambda b: relabel(b, model))
    pool.where(F.col("attr") != "upsample").write.parquet(src + "/batch=1")
    incremental(spark, src, pool.schema, sink, lambda b: relabel(b, model))
    return read_sink(spark, sink, SINK_SCHEMA).select("attr", "row_key", "old_intent_id", "intent_id", "intent")


_ = K


@register("src09_read_annotations", with_corpus() + """
, blind AS (
  SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS line_no, intent AS label,
         CAST((intent_id + CASE WHEN row_id % 5 = 0 THEN 1 ELSE 0 END) % 3 + 1 AS VARCHAR) AS code
  FROM corpus)
SELECT line_no, code, label FROM blind""")
def q_src09(spark, sf):
    c = corpus(spark, sf).orderBy("row_id")
    code = ((F.col("intent_id") + F.when(F.col("row_id") % 5 == 0, 1).otherwise(0)) % 3 + 1).cast("string")
    ap, lp = scratch_path(spark, "answers"), scratch_path(spark, "labels")
    c.select(code).write.text(ap)
    c.select("intent").write.text(lp)
    return RD.read_annotations(spark, ap + "/part-*", lp + "/part-*").select("line_no", "code", "label")


@register("snk02_metrics_json", """
WITH p AS (
  SELECT label, CAST((list_position(embedding, list_max(embedding)) - 1) % 10 AS INTEGER) AS pred,
         CASE WHEN substr(sha1(CAST(vec_id AS VARCHAR)), 1, 1) < 'c' THEN 'train'
              WHEN substr(sha1(CAST(vec_id AS VARCHAR)), 1, 1) < 'e' THEN 'val' ELSE 'test' END AS split
  FROM embeddings)
SELECT split AS config_id, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_rows
FROM p GROUP BY split""")
def q_snk02(spark, sf):
    from shotweave.operators.metrics import accuracy_scores, confusion_counts
    from shotweave.plans.q_metrics import predictions
    m = accuracy_scores(confusion_counts(predictions(spark, sf), ("split",)), ("split",))
    path = scratch_path(spark, "metrics-json")
    SK.write_metrics_json(m.withColumnRenamed("split", "config_id"), path)
    back = spark.read.text(path).select(F.explode(F.from_json(
        "value", "map<string,struct<accuracy:double,n_rows:bigint>>")).alias("config_id", "m"))
    return back.select("config_id", "m.accuracy", "m.n_rows")


@register("snk03_write_sheets", __import__("shotweave.plans.q_review", fromlist=["ROWS_SQL"]).ROWS_SQL + """
SELECT attr, regexp_replace(sheet, '[/<>]', '_', 'g') AS sheet, kind, text,
       coalesce(oracle_prediction, '') AS oracle_prediction, row_key FROM rrows""")
def q_snk03(spark, sf):
    from shotweave.plans.q_review import _rows
    rows = _rows(spark, sf)
    path = scratch_path(spark, "sheets")
    SK.write_sheets(rows, path)
    return SK.read_sheets(spark, path, "kind string, text string, oracle_prediction string, row_key string")


@register("snk04_write_or_reuse", with_corpus() + "SELECT split, count(*) AS n_rows FROM corpus GROUP BY split")
def q_snk04(spark, sf):
    path = scratch_path(spark, "plot-frame")
    df = corpus(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    SK.write_or_reuse(spark, df, path)
    return SK.write_or_reuse(spark, df, path)  # second call reads the stored frame back
