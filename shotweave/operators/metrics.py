"""Classification and diversity metrics.

All classification metrics derive from one ``groupBy(group, label, pred).count()``
table (at most C^2 rows per group), so predictions are scanned once. Macro
scores use the union of labels seen in truth or prediction; an undefined
per-class score is 0 (the usual library default).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from shotweave.sources.tables import durable

ROUND = 6


def confusion_counts(df: DataFrame, group: Sequence[str] = (), label: str = "label",
                     pred: str = "pred") -> DataFrame:
    return (df.groupBy(*group, F.col(label).alias("label"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def per_class(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``group, cls, tp, t, p`` over the union of true and predicted classes (no joins)."""
    both = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"),
                 F.lit(0).cast("long").alias("tp")))
    e = counts.select(*group, F.explode(both).alias("e")).select(*group, "e.*")
    return e.groupBy(*group, "cls").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"),
                                        F.sum("p").alias("p"))


def _f1(tp, t, p):
    return F.when(t + p > 0, 2.0 * tp / (t + p)).otherwise(0.0)


def macro_scores(counts: DataFrame, group: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Macro F1, precision, recall (MET-03, MET-05, MET-06)."""
    c = per_class(counts, group)
    return c.groupBy(*group).agg(
        F.round(F.avg(_f1(F.col("tp"), F.col("t"), F.col("p"))), ROUND).alias(f"{prefix}f1"),
        F.round(F.avg(F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0)), ROUND)
        .alias(f"{prefix}precision"),
        F.round(F.avg(F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)), ROUND)
        .alias(f"{prefix}recall"))


def accuracy_scores(counts: DataFrame, group: Sequence[str] = (), oos_id=None) -> DataFrame:
    """Accuracy (MET-01), in-scope accuracy (MET-02), OOS recall (MET-07)."""
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    aggs = [F.round(F.sum(hit) / F.sum("n"), ROUND).alias("accuracy"),
            F.sum("n").alias("n_rows")]
    if oos_id is not None:
        ins = F.col("label") != F.lit(oos_id)
        aggs.append(F.round(F.sum(F.when(ins, hit)) / F.sum(F.when(ins, F.col("n"))), ROUND)
                    .alias("inscope_accuracy"))
        is_oos = F.col("label") == F.lit(oos_id)
        aggs.append(F.round(F.sum(F.when(is_oos, hit)) / F.sum(F.when(is_oos, F.col("n"))), ROUND)
                    .alias("oos_recall"))
    return counts.groupBy(*group).agg(*aggs)


def classification_report(df: DataFrame, group: Sequence[str] = (), oos_id=None,
                          label: str = "label", pred: str = "pred") -> DataFrame:
    """All classification metrics per group from one counts table (MET-01..07)."""
    return compute_metrics(df, ["accuracy", "f1", "precision", "recall"], group, oos_id,
                           label, pred)


# MET-08 ----------------------------------------------------------------------
def confusion_matrix(spark: SparkSession, df: DataFrame, num_labels: int,
                     label: str = "label", pred: str = "pred") -> DataFrame:
    """Dense ``num_labels x num_labels`` matrix in long form, zeros filled."""
    grid = spark.range(num_labels * num_labels).select(
        (F.col("id") / num_labels).cast("int").alias("label"),
        (F.col("id") % num_labels).cast("int").alias("pred"))
    c = confusion_counts(df, (), label, pred)
    return grid.join(c, ["label", "pred"], "left").select(
        "label", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# MET-09 ----------------------------------------------------------------------
def fidelity(relabelled: DataFrame, attr: str = "attr", old: str = "old_intent_id",
             new: str = "intent_id") -> DataFrame:
    """Share of rows whose new label equals the old, per attr; ``val`` shown as ``threshold``."""
    name = F.when(F.col(attr) == "val", F.lit("threshold")).otherwise(F.col(attr))
    return (relabelled.groupBy(name.alias("attr"))
            .agg(F.round(F.avg((F.col(old) == F.col(new)).cast("double")), ROUND).alias("fidelity"),
                 F.count(F.lit(1)).alias("n_rows")))


# MET-10 ----------------------------------------------------------------------
def classwise(df: DataFrame, by: str, truth: str, guess: str, group: Sequence[str] = ()) -> DataFrame:
    """Overall and per-class agreement via ``rollup``; the overall row has ``by`` null."""
    return df.rollup(*group, by).agg(
        F.round(F.avg((F.col(truth) == F.col(guess)).cast("double")), ROUND).alias("agreement"),
        F.count(F.lit(1)).alias("n_rows"))


# MET-11 ----------------------------------------------------------------------
def pct_text(x: Column) -> Column:
    """Percent with two decimals, e.g. ``0.6026 -> '60.26'``.

    The share is scaled to hundredths of a percent and rounded half-up as a
    binary double first, then printed with integer arithmetic, so every engine
    prints the same text (``format_string('%.2f')`` rounds the shortest decimal
    form instead, and engines disagree on ties such as 2.675)."""
    h = F.round(x * 10000.0).cast("long")
    return F.concat((h / 100).cast("long").cast("string"), F.lit("."),
                    F.lpad((h % 100).cast("string"), 2, "0"))


# MET-12 / MET-13 ---------------------------------------------------------------
TTR_TOKEN = "\\p{L}+|\\p{N}+|[^\\p{L}\\p{N}\\s]"
GRAM = np.dtype([("u", np.uint64), ("v", np.uint64)])  # 128 bits of a gram
GRAM_STRETCH = 1 << 21  # grams that a task looks through at a time for repeats
GRAM_PARTS = 4  # blocks for each shuffle partition
GRAM_PASSES = 6  # for texts whose grams, together, would fill the disks


def ngram_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TTR_TOKEN), 0)


def ttr(df: DataFrame, ns: Sequence[int] = (1, 2, 3, 4), group: Sequence[str] = (),
        text: str = "text", approx_rsd: float | None = None, passes: int = 1) -> DataFrame:
    """Type-token ratio of n-grams built inside each sentence.

    A gram is 128 bits of its tokens' hashes. Tasks keep each gram of a stretch of rows once and hand them on in blocks
    by hash; a block's distinct grams are counted together. So no row is shuffled for a gram, and none spills.
    The distinct grams of a text take several times its place on disk. With more ``passes`` each reads ``df`` again and counts the grams
    of its share of the hashes; its counts are written and its blocks removed before the next pass begins.
    ``approx_rsd``: sketches instead, of structs of ``n`` shifted slices zipped together.
    """
    if approx_rsd is None:
        return _exact_ttr(df, [int(n) for n in ns], list(group), text, passes)
    width = max(ns)
    toks = df.select(*group, ngram_tokens(F.col(text)).alias("_t"))
    t, size = F.col("_t"), F.size("_t")

    def grams(n: int) -> Column:
        cnt = F.greatest(size - n + 1, F.lit(0))
        cols = ([F.array_repeat(F.lit(n), cnt)] + [F.slice(t, k + 1, cnt) for k in range(n)]
                + [F.array_repeat(F.lit(None).cast("string"), cnt) for _ in range(width - n)])
        return F.arrays_zip(*cols)

    g = toks.select(*group, F.explode(F.concat(*[grams(int(n)) for n in ns])).alias("g"))
    # One pass with mergeable HyperLogLog sketches: no per-gram shuffle, for
    # corpora where an approximate type count (relative error approx_rsd) is enough.
    return (g.groupBy(*group, F.col("g").getField("0").alias("n"))
            .agg(F.approx_count_distinct(F.to_json("g"), approx_rsd).alias("types"),
                 F.count(F.lit(1)).alias("tokens"))
            .withColumn("ttr", F.round(F.col("types") / F.col("tokens"), ROUND)))


def _exact_ttr(df: DataFrame, ns: list[int], group: list[str], text: str, passes: int) -> DataFrame:
    spark = df.sparkSession
    # blocks are counted one at a time: more tasks, smaller blocks
    parts = -(-GRAM_PARTS * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) // passes)
    keys = [f"_g{i}" for i in range(len(group))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(group, keys, strict=True)], ngram_tokens(F.col(text)).alias("_t")).select(
        *keys, F.transform("_t", lambda t: F.xxhash64(F.lit(1), t)).alias("_a"),
        F.transform("_t", lambda t: F.xxhash64(F.lit(2), t)).alias("_b"))
    kinds = [rows.schema[k] for k in keys]
    fields = [*kinds, StructField("n", IntegerType()), StructField("_part", IntegerType()), StructField("c", LongType()),
              StructField("_grams", BinaryType())]

    def count(block: pa.Table) -> pa.Table:
        grams = np.concatenate([_unpacked(b) for b in block["_grams"].to_pylist()])
        return pa.table({**{k: block[k].slice(0, 1) for k in [*keys, "n"]}, "types": pa.array([len(_distinct(grams))], pa.int64()),
                         "c": pa.array([sum(block["c"].to_pylist())], pa.int64())})

    def counted(share: range) -> DataFrame:
        dealt = rows.mapInArrow(lambda batches: _dealt(batches, keys, ns, share, parts), StructType(fields))
        return dealt.groupBy(*keys, "n", "_part").applyInArrow(
            count, StructType([*fields[:-3], StructField("types", LongType()), StructField("c", LongType())]))

    counts = None
    for i in range(passes):
        one = counted(range((i << 64) // passes, (i + 1 << 64) // passes))
        if passes > 1:
            one = durable(one.groupBy(*keys, "n").agg(F.sum("types").alias("types"), F.sum("c").alias("c")), "gram-counts")
        counts = one if counts is None else counts.unionByName(one)
    return (counts.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, group, strict=True)], "n")
            .agg(F.sum("types").alias("types"), F.sum("c").alias("tokens"))
            .withColumn("ttr", F.round(F.col("types") / F.col("tokens"), ROUND)))


def _dealt(batches: Iterator[pa.RecordBatch], keys: list[str], ns: list[int], share: range, parts: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's grams, stretch by stretch; ``share``: the hashes of the grams that count."""
    held, size, types = {}, 0, []
    for batch in batches:
        types = [batch.schema.field(k).type for k in keys]
        values = [batch.column(k).to_pylist() for k in keys]
        own: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*values, strict=True) if keys else [()] * batch.num_rows):
            own.setdefault(key, []).append(i)
        for key, at in own.items():
            part = batch if len(at) == batch.num_rows else batch.take(pa.array(at))
            for n, grams in _grams(part.column("_a"), part.column("_b"), ns, share):
                held.setdefault((key, n), []).append(grams)
                size += len(grams)
        if size >= GRAM_STRETCH:
            yield from _blocks(held, keys, types, share, parts)
            held, size = {}, 0
    yield from _blocks(held, keys, types, share, parts)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(a: pa.Array, b: pa.Array, ns: list[int], share: range) -> Iterator[tuple[int, np.ndarray]]:
    """For each ``n`` the grams of lists of token hashes that ``share`` holds, none across two lists."""
    size = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.repeat(np.cumsum(size), size)
    x, y = (c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (a, b))
    at = np.arange(len(x))
    u = np.zeros(len(x), np.uint64)
    for n in range(1, max(ns, default=0) + 1):
        fits = at + n <= end[at]
        at = at[fits]
        u = _mix(u[fits] * np.uint64(0x9E3779B97F4A7C15) + x[at + (n - 1)])
        if n not in ns:
            continue
        mine = (u >= np.uint64(share.start)) & (u <= np.uint64(share.stop - 1))
        first = at[mine]
        v = np.zeros(len(first), np.uint64)
        for j in range(n):
            v = _mix(v * np.uint64(0xC2B2AE3D27D4EB4F) + y[first + j])
        grams = np.zeros(len(first), GRAM)
        grams["u"], grams["v"] = u[mine], v
        yield n, grams


def _distinct(grams: np.ndarray) -> np.ndarray:
    """Each gram once, in order."""
    grams = grams[np.argsort(grams["u"])]
    alike = grams["u"][1:] == grams["u"][:-1]
    if (alike & (grams["v"][1:] != grams["v"][:-1])).any():
        grams = grams[np.lexsort((grams["v"], grams["u"]))]
    new = np.ones(len(grams), bool)
    new[1:] = (grams["u"][1:] != grams["u"][:-1]) | (grams["v"][1:] != grams["v"][:-1])
    return grams[new]


def _packed(grams: np.ndarray) -> bytes:
    """Grams in order as bytes: those of the steps from hash to hash by place, so that the many high zeros stand together and the
    shuffle's compression takes them out."""
    step = np.diff(grams["u"], prepend=np.uint64(0))
    return step.view(np.uint8).reshape(-1, 8).T.tobytes() + grams["v"].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 16
    grams = np.zeros(n, GRAM)
    steps = np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T
    grams["u"] = np.cumsum(np.ascontiguousarray(steps).view(np.uint64).ravel(), dtype=np.uint64)
    grams["v"] = np.frombuffer(data, np.uint64, n, 8 * n)
    return grams


def _blocks(held: dict, keys: list[str], types: list[pa.DataType], share: range, parts: int) -> Iterator[pa.RecordBatch]:
    """The grams of a stretch, cut by hash into ``parts`` blocks: with few grams, only those that hold any."""
    step = np.uint64((share.stop - share.start) // parts + 1)
    for (key, n), grams in held.items():
        total = sum(map(len, grams))
        if not total:
            continue
        kept = _distinct(np.concatenate(grams))
        part = ((kept["u"] - np.uint64(share.start)) // step).astype(np.int32)
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        data = [_packed(kept[i:j]) for i, j in zip(at, [*at[1:], len(kept)], strict=True)]
        yield pa.RecordBatch.from_pydict(
            {**{k: pa.array([v] * len(at), t) for k, v, t in zip(keys, key, types, strict=True)}, "n": pa.array([n] * len(at), pa.int32()),
             "_part": pa.array(part[at]), "c": pa.array([total] + [0] * (len(at) - 1), pa.int64()), "_grams": pa.array(data, pa.binary())})


# MET-14 / UDF-02 ---------------------------------------------------------------
METRICS: dict[str, Callable[[DataFrame, Sequence[str], object], DataFrame]] = {}


def register_metric(name: str):
    def deco(fn):
        METRICS[name] = fn
        return fn
    return deco


@register_metric("accuracy")
def _m_accuracy(counts, group, oos_id):
    return accuracy_scores(counts, group, oos_id)


@register_metric("f1")
def _m_f1(counts, group, oos_id):
    out = macro_scores(counts, group).select(*group, "f1")
    if oos_id is not None:
        ins = macro_scores(counts.where(F.col("label") != F.lit(oos_id)), group, "inscope_")
        out = out.join(ins.select(*group, "inscope_f1"), list(group), "left")
    return out


@register_metric("precision")
def _m_precision(counts, group, oos_id):
    return macro_scores(counts, group).select(*group, "precision")


@register_metric("recall")
def _m_recall(counts, group, oos_id):
    return macro_scores(counts, group).select(*group, "recall")


def compute_metrics(df: DataFrame, names: Sequence[str], group: Sequence[str] = (),
                    oos_id=None, label: str = "label", pred: str = "pred") -> DataFrame:
    """Run the requested metrics in sorted name order and merge them into one record per group."""
    keys = list(group) if group else ["_all"]
    if not group:
        df = df.withColumn("_all", F.lit(0))
    counts = confusion_counts(df, keys, label, pred)
    out = None
    for name in sorted(names):
        if name not in METRICS:
            raise ValueError(f"unknown metric {name!r}")
        part = METRICS[name](counts, keys, oos_id)
        if out is None:
            out = part
        else:
            dup = [c for c in part.columns if c in out.columns and c not in keys]
            out = out.join(part.drop(*dup), keys, "left")
    return out if group else out.drop("_all")


# MET-15 ------------------------------------------------------------------------
def evaluate_splits(pred: DataFrame, oos_id=None, intrinsic: bool = False) -> DataFrame:
    """Metrics for every non-train split, prefixed ``test``/``valid``; scope
    ``overall`` for ``full*`` splits else ``few_shot`` (intrinsic: scope = split)."""
    p = pred.where(F.col("split") != "train")
    scope = (F.col("split") if intrinsic else
             F.when(F.col("split").startswith("full"), "overall").otherwise("few_shot"))
    prefix = F.when(F.col("split").contains("test"), "test").otherwise("valid")
    p = p.withColumn("scope", scope).withColumn("prefix", prefix)
    return classification_report(p, ("scope", "prefix", "split"), oos_id)
