"""Readers for the labelled-utterance formats, label maps, run trees and
persisted tables. Every reader takes an explicit schema (no inference)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.functions.text import py_strip
from shotweave.operators.labels import route_split
from shotweave.sources.tables import durable

SPLIT_JSON_TYPE = "map<string,array<array<string>>>"


# SRC-01 ------------------------------------------------------------------------
def read_split_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file: split key -> list of [text, intent] pairs.

    Each file is one document (whole-text read), so a single file is one task;
    use :func:`read_split_jsonl` for large inputs."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.explode(F.from_json("value", SPLIT_JSON_TYPE)).alias("split_key", "pairs"))
    rows = m.select("split_key", F.posexplode("pairs").alias("pos", "pair"))
    return rows.select("split_key", route_split(F.col("split_key")).alias("split"), "pos",
                       F.col("pair")[0].alias("text"), F.col("pair")[1].alias("intent"))


JSONL_SCHEMA = T.StructType([T.StructField("split_key", T.StringType()),
                             T.StructField("text", T.StringType()),
                             T.StructField("intent", T.StringType())])


def read_split_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines ``{"split_key", "text", "intent"}``: splittable, for large inputs."""
    df = spark.read.schema(JSONL_SCHEMA).json(path)
    return df.withColumn("split", route_split(F.col("split_key")))


# SRC-02 ------------------------------------------------------------------------
def read_line_file(spark: SparkSession, path: str, col: str) -> DataFrame:
    """Lines with their global 0-based index, in the order of file names and of lines in them, as ``line_no, <col>``.

    A line ends at ``\\n`` only. Files are read in splits of any assignment to tasks: rows are written with their split and
    their place in it, and numbered by the counts of the splits before, a table of one row per split."""
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    rows = durable(spark.read.option("lineSep", "\n").text(path)
                   .select(F.col("value").alias(col), *split, F.monotonically_increasing_id().alias("_id")), "lines")
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (rows.groupBy("_file", "_block").agg(F.count("*").alias("c"), F.min("_id").alias("_first"))
              .select("_file", "_block", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    return (rows.join(F.broadcast(splits), ["_file", "_block"])  # a row per split of the files
            .select((F.col("_id") + F.col("_shift")).alias("line_no"), col))


def read_parallel_lines(spark: SparkSession, text_path: str, label_path: str) -> DataFrame:
    """Zip two line files by line number; both sides stripped."""
    t = read_line_file(spark, text_path, "text")
    lab = read_line_file(spark, label_path, "intent")
    return t.join(lab, "line_no").select("line_no", py_strip(F.col("text")).alias("text"), py_strip(F.col("intent")).alias("intent"))


# SRC-03 ------------------------------------------------------------------------
def read_labelled_csv(spark: SparkSession, path: str, text: str = "text", category: str = "category") -> DataFrame:
    schema = T.StructType([T.StructField(text, T.StringType()), T.StructField(category, T.StringType())])
    df = spark.read.schema(schema).option("header", True).option("multiLine", False).csv(path)
    return df.select(F.col(text).alias("text"), F.col(category).alias("intent"))


# SRC-04 ------------------------------------------------------------------------
def read_columnar(spark: SparkSession, path: str, label_col: str = "label") -> DataFrame:
    return spark.read.parquet(path).withColumnRenamed(label_col, "intent")


# SRC-06 ------------------------------------------------------------------------
def read_generic(spark: SparkSession, path: str, fmt: str, schema: str | None = None, **options) -> DataFrame:
    r = spark.read.format(fmt).options(**options)
    if schema:
        r = r.schema(schema)
    return r.load(path)


# SRC-07 ------------------------------------------------------------------------
def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """``{"name": id, ...}`` objects (one per file) -> ``(intent, intent_id)``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,int>")).alias("intent", "intent_id"))


def write_label_map(label_dim: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Label map as one JSON object ``{"name": id}`` (the map has a bounded size)."""
    obj = label_dim.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("intent", "intent_id"))))).alias("value"))
    obj.coalesce(1).write.mode(mode).text(path)


# SRC-08 ------------------------------------------------------------------------
EXP_SCHEMA = T.StructType([
    T.StructField("dataset", T.StructType([T.StructField("name", T.StringType()),
                                           T.StructField("config", T.StringType()),
                                           T.StructField("oos_id", T.LongType())])),
    T.StructField("exp_type", T.StringType()),
    T.StructField("gpt3_engine", T.StringType()),
    T.StructField("gpt3_temp", T.StringType()),
    T.StructField("run#", T.LongType()),
])


def _folder(path_col) -> F.Column:
    return F.regexp_extract(path_col, "([^/]+)/(code/results|exp_dict)\\.json$", 1)


def read_run_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``root/<folder>/exp_dict.json`` and ``root/<folder>/code/results.json`` ->
    ``runs(folder, dataset, config, oos_id, exp_type, engine, temp, run)`` and
    ``run_results(folder, scope, key, value)`` (scope null for flat results)."""
    ex = (spark.read.schema(EXP_SCHEMA).option("multiLine", True)
          .option("recursiveFileLookup", True).option("pathGlobFilter", "exp_dict.json").json(root)
          .select(_folder(F.col("_metadata.file_path")).alias("folder"),
                  F.col("dataset.name").alias("dataset"), F.col("dataset.config").alias("config"),
                  F.col("dataset.oos_id").alias("oos_id"), "exp_type",
                  F.col("gpt3_engine").alias("engine"), F.col("gpt3_temp").alias("temp"),
                  F.col("`run#`").cast("int").alias("run")))
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "results.json")
           .text(root, wholetext=True)
           .select(_folder(F.col("_metadata.file_path")).alias("folder"), "value"))
    body = raw.select("folder", F.explode(F.from_json("value", "map<string,string>")).alias("cfg", "b"))
    flat = (body.select("folder", F.explode(F.from_json("b", "map<string,double>")).alias("key", "value"))
            .select("folder", F.lit(None).cast("string").alias("scope"), "key", "value"))
    nested = (body.select("folder", F.explode(F.from_json("b", "map<string,map<string,double>>")).alias("scope", "m"))
              .select("folder", "scope", F.explode("m").alias("key", "value")))
    return ex, flat.unionByName(nested)


# SRC-09 ------------------------------------------------------------------------
def read_annotations(spark: SparkSession, answers_path: str, labels_path: str) -> DataFrame:
    """Coded answers and true labels, paired by line; unpaired lines raise."""
    from shotweave.operators.review import pair_lines
    a = read_line_file(spark, answers_path, "code")
    lab = read_line_file(spark, labels_path, "label")
    return pair_lines(a, lab)


# SRC-10 ------------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
               where: str | None = None) -> DataFrame:
    """Reload a persisted table; a ``where`` on partition columns prunes directories."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(path)
    return df.where(where) if where else df


# SRC-05 / UDF-03 -----------------------------------------------------------------
@dataclass
class DatasetSpec:
    name: str
    reader: Callable[..., DataFrame]
    num_examples: int = 10
    oos: str | None = None
    domain_rule: str = "prefix"          # prefix | single | declared
    domain_map: dict = field(default_factory=dict)


_REGISTRY: dict[str, DatasetSpec] = {}


def register_dataset(spec: DatasetSpec) -> None:
    _REGISTRY[spec.name] = spec


def dataset_spec(name: str) -> DatasetSpec:
    if name not in _REGISTRY:
        raise NotImplementedError(f"Dataset {name} not supported")
    return _REGISTRY[name]


def load_dataset(spark: SparkSession, name: str, *args, **kwargs) -> DataFrame:
    return dataset_spec(name).reader(spark, *args, **kwargs)


# The four corpora the reference reads, their seed counts and readers.
register_dataset(DatasetSpec("clinc_oos", read_split_json, 10, "oos", "declared"))
register_dataset(DatasetSpec("snips_official", read_parallel_lines, 10, None, "declared"))
register_dataset(DatasetSpec("hwu64", read_labelled_csv, 10, None, "prefix"))
register_dataset(DatasetSpec("banking77", read_columnar, 10, None, "single"))
