"""The labelled utterance corpus derived from ``documents`` and ``labels``.

Columns: ``row_id LONG, text STRING, intent STRING, domain STRING,
intent_id INT, split STRING``.

* One utterance per line of every document: the whole text is used, line by
  line (``row_id = doc_id * 1_000_000 + line index``); a document of more lines than that raises.
* ``intent``: ``'oos'`` when the document's quality label is 0, else ``lang || '_' || source`` (``unknown`` where null).
* ``domain``: ``'oos'`` or the part of the intent before the first ``_``.
* ``intent_id``: dense rank of the intent among sorted in-scope names from 0;
  the out-of-scope class gets the last id.
* ``split``: first hex digit of ``sha1(doc_id)``: below ``c`` train, below ``e``
  val, else test. A document's lines share a split, so near-identical lines of
  one document never straddle train and test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.operators.labels import label_dictionary, prefix_domain
from shotweave.session import MAX_CLASSES
from shotweave.sources.tables import materialized, shuffles_removed

OOS = "oos"
LINE_KEY = 1_000_000  # row_id = doc_id * LINE_KEY + line index


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key) -> F.Column:
    h = F.substring(F.sha1(key.cast("string")), 1, 1)
    return F.when(h < "c", "train").when(h < "e", "val").otherwise("test")


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality")
    lines = docs.join(labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "quality", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    return lines.select(
        F.when(F.col("line_idx") < LINE_KEY, F.col("doc_id") * LINE_KEY + F.col("line_idx"))
        .otherwise(F.raise_error(F.lit(f"a document has more than {LINE_KEY} lines")).cast("long")).alias("row_id"),
        F.col("line").alias("text"),
        F.when(F.col("quality") == 0, F.lit(OOS))
        .otherwise(F.concat(F.coalesce("lang", F.lit("unknown")), F.lit("_"), F.coalesce("source", F.lit("unknown")))).alias("intent"),
        split_of(F.col("doc_id")).alias("split"),
    )


def build_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base_rows(spark, sf_dir)
    dim = label_dictionary(rows, oos=OOS)
    with shuffles_removed(spark):  # the texts may have been shuffled for it
        few = dim.limit(MAX_CLASSES + 1).count() <= MAX_CLASSES
    if few:  # a row per class: the lines stay where they are read
        dim = F.broadcast(dim)
    return (rows.join(dim, "intent")
            .withColumn("domain", prefix_domain(F.col("intent"), oos=OOS))
            .select("row_id", "text", "intent", "domain", "intent_id", "split"))


def corpus_inputs(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"]


def corpus(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The corpus, written once per input version to the checkpoint folder
    (partitioned by split) and read back; ``materialize=False`` gives the lazy plan."""
    if not materialize:
        return build_corpus(spark, sf_dir)
    df = materialized(spark, "corpus", corpus_inputs(sf_dir), lambda: build_corpus(spark, sf_dir),
                      partition_by="split")
    return df.select("row_id", "text", "intent", "domain", "intent_id", "split")


CORPUS_SQL = """
WITH doc_lines AS (
  SELECT d.doc_id, d.lang, d.source, l.quality,
         unnest(string_split(d.text, chr(10))) AS line,
         unnest(range(len(string_split(d.text, chr(10))))) AS line_idx
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), base AS (
  SELECT doc_id * 1000000 + line_idx AS row_id,
         line AS text,
         CASE WHEN quality = 0 THEN 'oos' ELSE coalesce(lang, 'unknown') || '_' || coalesce(source, 'unknown') END AS intent,
         CASE WHEN substr(sha1(CAST(doc_id AS VARCHAR)), 1, 1) < 'c' THEN 'train'
              WHEN substr(sha1(CAST(doc_id AS VARCHAR)), 1, 1) < 'e' THEN 'val'
              ELSE 'test' END AS split
  FROM doc_lines
), dim AS (
  SELECT intent, CAST(row_number() OVER (ORDER BY intent = 'oos', intent) - 1 AS INTEGER) AS intent_id
  FROM (SELECT DISTINCT intent FROM base) t
), corpus AS (
  SELECT b.row_id, b.text, b.intent,
         CASE WHEN b.intent = 'oos' THEN 'oos' ELSE split_part(b.intent, '_', 1) END AS domain,
         d.intent_id, b.split
  FROM base b JOIN dim d ON b.intent = d.intent
)
"""
