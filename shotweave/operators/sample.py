"""Few-shot sampling: hash-ordered top-K per class and leave-one-domain-out slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotweave.functions.rand import draw
from shotweave.session import MAX_CLASSES

SLICE_COLS = ["val_domain", "part", "split", "row_id", "text", "intent", "intent_id", "domain"]


def bounded_values(df: DataFrame, col: str, limit: int = MAX_CLASSES) -> list:
    """Sorted distinct values of a low-cardinality column (checked bound)."""
    vals = [r[0] for r in df.select(col).distinct().limit(limit + 1).collect()]
    if len(vals) > limit:
        raise ValueError(f"column {col!r} has more than {limit} distinct values")
    return sorted(v for v in vals if v is not None)


# FS-01 ---------------------------------------------------------------------
def hash_topk(df: DataFrame, k: int = 10, by: str = "intent", with_rank: bool = True) -> DataFrame:
    """Per class, the ``k`` rows with the smallest SHA-1 of the text (ties by ``row_id``).

    ``sha1`` hex digests have a fixed width, so string order equals the integer
    order of the digest. Catalyst plans this as a partial ``WindowGroupLimit``
    before the shuffle, so even a class holding a third of all rows ships at
    most ``k`` rows per map task.
    """
    w = Window.partitionBy(by).orderBy(F.sha1(F.col("text")), F.col("row_id"))
    out = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return out if with_rank else out.drop("rn")


def in_scope(corpus: DataFrame, oos: str = "oos") -> DataFrame:
    return corpus.where(F.col("intent") != F.lit(oos))


# FS-02 ---------------------------------------------------------------------
def many_shot(corpus: DataFrame, val_domain: str, oos: str = "oos") -> DataFrame:
    """M side for one held-out domain: all splits, intents outside the domain."""
    return (in_scope(corpus, oos).where(F.col("domain") != F.lit(val_domain))
            .withColumn("val_domain", F.lit(val_domain)).withColumn("part", F.lit("M")))


# FS-03 ---------------------------------------------------------------------
def few_shot(corpus: DataFrame, k: int = 10, val_domain: str | None = None,
             oos: str = "oos") -> DataFrame:
    """F side: the held-out domain's rows; train cut to ``k`` per class, val/test whole.

    Without ``val_domain`` the F sides of every domain are returned at once
    (each in-scope intent belongs to exactly one domain).
    """
    rows = in_scope(corpus, oos)
    if val_domain is not None:
        rows = rows.where(F.col("domain") == F.lit(val_domain))
    train = hash_topk(rows.where(F.col("split") == "train"), k, with_rank=False)
    rest = rows.where(F.col("split") != "train")
    return (train.unionByName(rest)
            .withColumn("val_domain", F.col("domain")).withColumn("part", F.lit("F")))


def few_shot_train(corpus: DataFrame, k: int = 10, oos: str = "oos") -> DataFrame:
    """All domains' F-train rows with their hash rank ``rn`` (1..k)."""
    return hash_topk(in_scope(corpus, oos).where(F.col("split") == "train"), k)


# FS-04 ---------------------------------------------------------------------
def leave_one_domain_out(corpus: DataFrame, k: int = 10, oos: str = "oos",
                         domains: list[str] | None = None) -> DataFrame:
    """M and F slices for every held-out domain, as one lazy DataFrame.

    M repeats the in-scope corpus once per other domain; keep it lazy and
    filter on ``val_domain`` early. The domain list is bounded metadata.
    """
    if domains is None:
        domains = bounded_values(in_scope(corpus, oos), "domain")
    doms = F.array(*[F.lit(d) for d in domains])
    m = (in_scope(corpus, oos)
         .withColumn("val_domain", F.explode(doms))
         .where(F.col("val_domain") != F.col("domain"))
         .withColumn("part", F.lit("M")))
    f = few_shot(corpus, k, oos=oos)
    return m.select(*SLICE_COLS).unionByName(f.select(*SLICE_COLS))


# FS-05 ---------------------------------------------------------------------
def train_class_sizes(corpus: DataFrame, oos: str = "oos") -> DataFrame:
    return (corpus.where(F.col("split") == "train")
            .groupBy("intent", "domain").agg(F.count(F.lit(1)).alias("cnt")))


def synthetic_quota(corpus: DataFrame, oos: str = "oos", domains: list[str] | None = None) -> DataFrame:
    """Per held-out domain: int(median of the M-train class sizes).

    Falls back to the median over all base-train classes when M is empty.

    Order statistics on a histogram of class sizes: running sums over the sizes of all in-scope classes give the rank of a
    size; between two sizes of the held-out domain, a constant number of classes is missing from that rank. So each of the
    domain's sizes looks up two ranks in the running sums, and the smallest size that lies in its stretch counts. The
    histogram has one row per different size, at most sqrt(2 n) of them for n rows, a look-up per (domain, size).
    """
    sizes = train_class_sizes(corpus, oos)
    ins = sizes.where(F.col("intent") != F.lit(oos))
    by_size = Window.orderBy("cnt")
    hist = ins.groupBy("cnt").agg(F.count("*").alias("c")).select(F.sum("c").over(by_size).alias("x"), F.col("cnt").alias("size"))
    own = Window.partitionBy("domain").orderBy("cnt")
    steps = (ins.groupBy("domain", "cnt").agg(F.count("*").alias("c"))
             .select("domain", F.col("cnt").alias("begin"), F.lead("cnt").over(own).alias("end"), F.sum("c").over(own).alias("gone")))
    held = ins.groupBy("domain").agg(F.count("*").alias("classes"), F.min("cnt").alias("end"))
    if domains is not None:
        names = corpus.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
        held = names.join(held, "domain", "left").withColumn("classes", F.coalesce("classes", F.lit(0)))
        steps = steps.join(names, "domain", "left_semi")
    left = F.lit(ins.select(F.count("*").alias("n")).scalar()) - F.col("classes")
    ranks = held.select("domain", F.floor((left + 1) / 2).alias("low"), (F.floor(left / 2) + 1).alias("high"), left.alias("left"), "end")
    stretches = (ranks.select("domain", F.lit(0).cast("long").alias("begin"), "end", F.lit(0).cast("long").alias("gone"))
                 .unionByName(steps))
    asked = (stretches.join(ranks.where("left > 0").drop("end"), "domain")
             .select("domain", "begin", "end", F.explode(F.array("low", "high")).alias("rank"), "gone")
             .distinct()
             .select("domain", "begin", "end", "rank", (F.col("rank") + F.col("gone")).alias("x"), F.lit(None).cast("long").alias("size")))
    # the next running sum at or after each rank asked for
    none = [F.lit(None).cast(t).alias(c) for c, t in (("domain", "string"), ("begin", "long"), ("end", "long"), ("rank", "long"))]
    onward = Window.orderBy("x", F.col("size").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = asked.unionByName(hist.select(*none, "x", "size")).withColumn("size", F.first("size", ignorenulls=True).over(onward))
    value = F.greatest("size", "begin")
    found = (met.where(F.col("domain").isNotNull() & F.col("size").isNotNull() & (F.col("end").isNull() | (value < F.col("end"))))
             .groupBy("domain", "rank").agg(F.min(value).alias("v")).groupBy("domain").agg(F.avg("v").alias("median")))
    base = F.lit(sizes.select(F.median("cnt").alias("m")).scalar())
    return (ranks.join(found, "domain", "left")
            .select(F.col("domain").alias("val_domain"), F.floor(F.coalesce("median", base)).cast("long").alias("quota")))


# FS-06 ---------------------------------------------------------------------
def seed_rows(f_train: DataFrame, intents) -> DataFrame:
    if isinstance(intents, DataFrame):
        return f_train.join(intents.select("intent").distinct(), "intent", "left_semi")
    return f_train.where(F.col("intent").isin(list(intents)))


# FS-07 ---------------------------------------------------------------------
def keyed_shuffle(df: DataFrame, seed: str = "shuffle", key: str = "row_id") -> DataFrame:
    return df.withColumn("shuffle_key", draw(seed, F.col(key))).orderBy("shuffle_key", key)
