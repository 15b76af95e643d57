"""Label maps, splits and OOS handling (projections, filters, lookup joins)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.functions.arrays import argmax, one_hot
from shotweave.functions.rand import draw
from shotweave.session import MAX_CLASSES
from shotweave.sources.tables import numbered


class UnknownLabelError(ValueError):
    """A row carries a label name that the label dictionary does not know."""


# LBL-01 --------------------------------------------------------------------
def label_dictionary(df: DataFrame, col: str = "intent", oos: str | None = "oos") -> DataFrame:
    """Sorted distinct names -> dense ids from 0; ``oos`` (if present) gets the last id.

    The window has no partition key on purpose: it runs after ``distinct`` and
    therefore only ever sees the (bounded) set of label names.
    """
    names = df.select(col).where(F.col(col).isNotNull()).distinct()
    is_oos = (F.col(col) == F.lit(oos)) if oos is not None else F.lit(False)
    w = Window.orderBy(is_oos, F.col(col))
    return names.select(col, (F.row_number().over(w) - 1).cast("int").alias(f"{col}_id"))


# LBL-02 --------------------------------------------------------------------
def label_dictionary_from_list(spark: SparkSession, names: Sequence[str],
                               col: str = "intent") -> DataFrame:
    """Label dictionary in the given list order (fixed label lists); a list over MAX_CLASSES raises, see
    ``label_dictionary_in_order``."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(bounded(names))],
                                 f"{col} string, {col}_id int")


def label_dictionary_in_order(names: DataFrame, col: str = "intent") -> DataFrame:
    """Label dictionary in the order of a sorted table of distinct names, of any number."""
    return numbered(names.select(col), f"{col}_id").select(col, F.col(f"{col}_id").cast("int").alias(f"{col}_id"))


# LBL-03 --------------------------------------------------------------------
def encode_labels(df: DataFrame, label_dim: DataFrame, col: str = "intent",
                  unknown_labels: str = "raise") -> DataFrame:
    """Name -> id lookup. An unknown name raises (anti-join probe), unless ``unknown_labels="drop"`` asks to drop its rows."""
    if unknown_labels not in ("raise", "drop"):
        raise ValueError(f"unknown_labels: {unknown_labels!r}")
    if unknown_labels == "raise":
        unknown = df.select(col).join(label_dim, col, "left_anti").limit(1).collect()
        if unknown:
            raise UnknownLabelError(f"unknown label {unknown[0][0]!r}")
    return df.join(label_dim, col, "inner")


# LBL-04 --------------------------------------------------------------------
def decode_labels(df: DataFrame, label_dim: DataFrame, id_col: str = "intent_id",
                  name_col: str = "intent") -> DataFrame:
    dim = label_dim.select(F.col("intent_id").alias(id_col), F.col("intent").alias(name_col))
    return df.join(dim, id_col, "left")


# LBL-05 --------------------------------------------------------------------
def route_split(key: Column) -> Column:
    """Split key -> train / val / test: contains 'train', else contains 'val', else test."""
    return (F.when(key.contains("train"), "train")
            .when(key.contains("val"), "val").otherwise("test"))


# LBL-06 --------------------------------------------------------------------
def domain_map_rows(spark: SparkSession, domain_to_intents: dict[str, Sequence[str]]) -> DataFrame:
    """Declared ``{domain: [intents]}`` -> ``(domain, intent, pos)`` rows in declared order; a map over MAX_CLASSES raises,
    see ``domain_map_in_order``."""
    pairs = bounded([(d, i) for d, intents in domain_to_intents.items() for i in intents])
    return spark.createDataFrame([(d, i, pos) for pos, (d, i) in enumerate(pairs)], "domain string, intent string, pos int")


def domain_map_in_order(pairs: DataFrame) -> DataFrame:
    """``domain_map_rows`` of a sorted table of distinct pairs, of any number."""
    return numbered(pairs.select("domain", "intent"), "pos").select("domain", "intent", F.col("pos").cast("int").alias("pos"))


def bounded(items: Sequence) -> Sequence:
    """A declared list that goes into literals or a local table."""
    if len(items) > MAX_CLASSES:
        raise ValueError(f"{len(items)} declared entries; at most {MAX_CLASSES} fit a declared list")
    return items


# LBL-07 / LBL-08 -----------------------------------------------------------
def prefix_domain(intent: Column, oos: str | None = "oos") -> Column:
    """Domain = text before the first ``_`` (OOS keeps its own domain)."""
    d = F.substring_index(intent, "_", 1)
    return F.when(intent == F.lit(oos), F.lit(oos)).otherwise(d) if oos else d


def single_domain(name: str) -> Column:
    return F.lit(name)


# LBL-09 --------------------------------------------------------------------
def intent_domain(domain_map: DataFrame) -> DataFrame:
    """Intent -> domain, first declared match wins when an intent is listed twice."""
    w = Window.partitionBy("intent").orderBy("pos")
    return (domain_map.withColumn("rn", F.row_number().over(w))
            .where("rn = 1").select("intent", "domain"))


# LBL-10 --------------------------------------------------------------------
def group_by_intent(df: DataFrame) -> DataFrame:
    """The grouped view ``split -> intent -> texts`` as an ordered long table.

    Rows come out range-partitioned and sorted by ``(split, intent, row_id)``,
    so one class's texts are contiguous and in order, yet a class holding a
    third of all rows is still spread over many tasks: no group is collected
    into a single array or task.
    """
    return df.select("split", "intent", "row_id", "text").orderBy("split", "intent", "row_id")


# LBL-11 --------------------------------------------------------------------
RANK_BUCKETS = 1024


def stratified_split(df: DataFrame, p: float = 0.9, seed: str = "split",
                     label: str = "intent", buckets: int = RANK_BUCKETS) -> DataFrame:
    """Per class, the first ``round(p * n)`` rows by keyed draw go to train, the rest to val.

    Exact rank without sorting a whole class in one task: the draw range is
    cut into ``buckets``; a small ``(class, bucket)`` count table gives each
    bucket's rows-before offset, and rows are ranked only inside their bucket.
    """
    d = draw(seed, F.col("row_id"))
    x = df.withColumn("_d", d).withColumn("_b", F.floor(F.col("_d") * buckets).cast("int"))
    counts = x.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    cw = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("_before", F.coalesce(F.sum("_c").over(cw), F.lit(0)))
               .withColumn("_n", F.sum("_c").over(Window.partitionBy(label)))
               .select(label, "_b", "_before", "_n"))
    w = Window.partitionBy(label, "_b").orderBy("_d", "row_id")
    return (x.join(offsets, [label, "_b"])
            .withColumn("_rn", F.col("_before") + F.row_number().over(w))
            .withColumn("split", F.when(F.col("_rn") <= F.round(F.col("_n") * F.lit(p)), "train")
                        .otherwise("val"))
            .drop("_d", "_b", "_before", "_n", "_rn"))


# LBL-12 --------------------------------------------------------------------
def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.countDistinct("intent").alias("n_intents"))


# LBL-13 --------------------------------------------------------------------
def sheet_key(name: Column) -> Column:
    return F.regexp_replace(name, "\\?", "")


# LBL-14 --------------------------------------------------------------------
def with_one_hot(df: DataFrame, num_labels: int, id_col: str = "intent_id") -> DataFrame:
    return df.withColumn("label_vec", one_hot(F.col(id_col), num_labels))


# LBL-15 --------------------------------------------------------------------
def seq2seq_format(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.concat("text", F.lit(" </s>")).alias("text"),
                     F.concat("intent", F.lit(" </s>")).alias("target"))


# LBL-16 / LBL-17 / LBL-18 ---------------------------------------------------
def filter_oos(df: DataFrame, oos_id: int | None, id_col: str = "intent_id") -> DataFrame:
    if oos_id is None:
        return df
    return df.where(F.col(id_col) != F.lit(oos_id))


def filter_oos_soft(df: DataFrame, oos_id: int | None, vec_col: str = "label_vec") -> DataFrame:
    if oos_id is None:
        return df
    return df.where(argmax(F.col(vec_col)) != F.lit(oos_id))


def extract_oos(df: DataFrame, oos_id: int | None, id_col: str = "intent_id") -> DataFrame:
    if oos_id is None:
        return df.limit(0)
    return df.where(F.col(id_col) == F.lit(oos_id))


# LBL-19 --------------------------------------------------------------------
def keep_intents(df: DataFrame, subset: DataFrame | Sequence[str], col: str = "intent") -> DataFrame:
    if isinstance(subset, DataFrame):
        return df.join(subset.select(col).distinct(), col, "left_semi")
    return df.where(F.col(col).isin(list(subset)))
