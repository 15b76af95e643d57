"""The training-data pipeline over ``documents``: each stage's result is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of ``documents``.

Every stage works on all rows its predecessor kept: toxicity rejects documents whose score reaches the limit; line
dedup takes lines spread over many sites out of all texts; the n-gram Jaccard join keeps one row of each class, that
of the smallest doc_id (and all rows without words); decontamination drops documents that hold a benchmark item; packing
cuts the rest into sequences. Each row is decided on by its own text: stages that drop rows give every row a key
first, so rows that repeat a doc_id, or with a null one, stay or go on their own. Only labels go by doc_id; a
class keeps a row with a null doc_id if no other has one.

Helper tables live until the next stage begins: a stage's result is written down by then, so each stage first deletes what
those before it have left, but for tables that its own documents are read from. ``run`` also deletes a stage's result once
the next one is written.

Defined results: empty tables go through all stages and give no pieces; further columns of documents are carried along,
whatever their names; very long texts are handled whole, as the stages' operators state.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm import queries as Q
from shotweave.llm.common import BROADCAST_ROWS, drop_helpers, durable, free_name, recorded, small_batches, table
from shotweave.llm.decontaminate import contaminated
from shotweave.llm.packing import pack
from shotweave.llm.parity_join import ngram_jaccard_join
from shotweave.llm.site_lines import remove_site_lines
from shotweave.llm.toxic_segments import fit_segments, held_out, score_toxicity
from shotweave.session import checkpoint_dir
from shotweave.sources.tables import file_system


KEY = "_row_key"


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key for each row, written once so that all readers see the same keys; the key's column."""
    key = free_name(docs, KEY)
    return durable(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _by_key(rows: DataFrame, key: str) -> DataFrame:
    """The texts with the rows' keys in place of doc_id."""
    return rows.select(F.col(key).alias("doc_id"), "text")


def _without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``keys`` (durable)."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, key, "left_anti").drop(key)


def _stage(fn):
    """A stage that begins by deleting the helper tables of the stages before it and notes down its own."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_helpers(docs)
        with recorded(), small_batches(spark):
            return fn(spark, docs, sf_dir)
    return run_stage


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _keyed(docs)
    model = fit_segments(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    bad = score_toxicity(_by_key(rows, key), model).where(F.col("score") >= Q.TOXIC_FROM)
    return _without(rows, durable(bad.select(F.col("doc_id").alias(key)), "toxic"), key)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_site_lines(docs, Q.MIN_SITES)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _keyed(docs)
    classes = ngram_jaccard_join(_by_key(rows, key)).select(F.col("doc_id").alias("k"), "component_id")
    own = durable(rows.select(F.col(key).alias("k"), "doc_id").join(classes, "k"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("first")
    kept = own.groupBy("component_id").agg(first).select("first.k")
    return _without(rows, durable(own.select("k").join(kept, "k", "left_anti").select(F.col("k").alias(key)), "copies"), key)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _keyed(docs)
    leaks = contaminated(_by_key(rows, key), table(spark, sf_dir, "benchmark"))
    return _without(rows, durable(leaks.select(F.col("doc_id").alias(key)).distinct(), "leaks"), key)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, Q.tokenizer_path())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]

#: Trained scores, edit distances and tokenizers can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared checkpoint folder."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/shotweave-llm/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
        if before:
            fs, p = file_system(spark, before)
            fs.delete(p, True)
        before = f"{base}/{name}"
    drop_helpers(docs)
    return docs
