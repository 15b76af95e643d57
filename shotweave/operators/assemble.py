"""Training-set assembly for each experiment setting (UNION ALL of slices,
generated rows, relabelled rows and OOS rows; no de-duplication).

Every setting returns one DataFrame ``split, text, intent_id`` (soft-label
settings: ``split, text, label_vec``); ``get_split`` selects one split. No
setting loops over domains: the slices are filtered by column, so one job
builds the set for all domains at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.functions.arrays import argmax, one_hot
from shotweave.operators.sample import few_shot_train, in_scope

COLS = ["split", "text", "intent_id"]


def _as(df: DataFrame, split: str) -> DataFrame:
    return df.select(F.lit(split).alias("split"), "text", F.col("intent_id").cast("int").alias("intent_id"))


def _base(corpus: DataFrame, split: str) -> DataFrame:
    return _as(corpus.where(F.col("split") == split), split)


def _eval_splits(corpus: DataFrame, oos_id, dataset_oos_id) -> DataFrame:
    v, t = _base(corpus, "val"), _base(corpus, "test")
    if oos_id is None and dataset_oos_id is not None:
        v = v.where(F.col("intent_id") != F.lit(dataset_oos_id))
        t = t.where(F.col("intent_id") != F.lit(dataset_oos_id))
    return v.unionByName(t)


def _oos_train(corpus: DataFrame, oos_id) -> DataFrame:
    return _as(corpus.where((F.col("split") == "train") & (F.col("intent_id") == F.lit(oos_id))), "train")


# ASM-02..ASM-07 -------------------------------------------------------------------
def few_pure(corpus: DataFrame, exp_type: str, k: int, oos_id=None, dataset_oos_id=None,
             generated: DataFrame | None = None, relabelled: DataFrame | None = None,
             attr: str | None = None) -> DataFrame:
    """``few_pure`` settings: baseline, eda, generated attr, oracle (relabelled)."""
    f_train = _as(few_shot_train(corpus, k), "train")
    if exp_type == "baseline":
        train = f_train
    elif exp_type in ("eda", "gpt3", "generated"):
        a = "eda" if exp_type == "eda" else attr
        train = f_train.unionByName(_as(generated.where(F.col("attr") == a), "train"))
    elif exp_type.endswith("_oracle"):
        a = attr or exp_type.split("_")[0]
        train = f_train.unionByName(_as(relabelled.where(F.col("attr") == a), "train"))
    else:
        raise ValueError(f"unknown few_pure exp_type {exp_type!r}")
    if oos_id is not None:
        train = train.unionByName(_oos_train(corpus, oos_id))
    return train.unionByName(_eval_splits(corpus, oos_id, dataset_oos_id))


def few_pure_mixed(corpus: DataFrame, mixed: DataFrame, num_labels: int, oos_id=None,
                   dataset_oos_id=None) -> DataFrame:
    """``few_pure`` gpt3mix: the mixed set (seeds and OOS included) as train, soft labels kept."""
    train = mixed.select(F.lit("train").alias("split"), "text", "label_vec")
    if oos_id is None and dataset_oos_id is not None:
        train = train.where(argmax(F.col("label_vec")) != F.lit(dataset_oos_id))
    ev = _eval_splits(corpus, oos_id, dataset_oos_id).select(
        "split", "text", one_hot(F.col("intent_id"), num_labels).alias("label_vec"))
    return train.unionByName(ev)


# ASM-08 / ASM-09 --------------------------------------------------------------------
def full(corpus: DataFrame, exp_type: str, oos_id=None, generated: DataFrame | None = None,
         attrs=None) -> DataFrame:
    if exp_type == "baseline":
        return _base(corpus, "train").unionByName(_base(corpus, "val")).unionByName(_base(corpus, "test"))
    if exp_type == "intrinsic":
        parts = [_base(corpus, s) for s in ("train", "val", "test")]
        out = parts[0].unionByName(parts[1]).unionByName(parts[2])
        if oos_id is not None:
            out = out.where(F.col("intent_id") != F.lit(oos_id))
        g = generated.where(F.col("domain") != "oos")
        if attrs is not None:
            g = g.where(F.col("attr").isin(list(attrs)))
        return out.unionByName(g.select(F.col("attr").alias("split"), "text",
                                        F.col("intent_id").cast("int").alias("intent_id")))
    raise ValueError(f"unknown full exp_type {exp_type!r}")


# ASM-10 ---------------------------------------------------------------------------
def full_domain(corpus: DataFrame, val_domain: str, exp_type: str, k: int, oos_id=None,
                generated: DataFrame | None = None, attr: str | None = None) -> DataFrame:
    """train = M ∪ F (∪ generated); validation/test = F; full_* = M ∪ F (+ OOS)."""
    ins = in_scope(corpus)
    m = ins.where(F.col("domain") != F.lit(val_domain))
    f_rows = ins.where(F.col("domain") == F.lit(val_domain))
    f_train = few_shot_train(f_rows, k)
    train = _as(m.where(F.col("split") == "train"), "train").unionByName(_as(f_train, "train"))
    if exp_type in ("upsample", "gpt3", "generated"):
        a = "upsample" if exp_type == "upsample" else attr
        g = generated.where((F.col("attr") == a) & (F.col("domain") == F.lit(val_domain)))
        train = train.unionByName(_as(g, "train"))
    fval = _as(f_rows.where(F.col("split") == "val"), "validation")
    ftest = _as(f_rows.where(F.col("split") == "test"), "test")
    full_val = _as(ins.where(F.col("split") == "val"), "full_validation")
    full_test = _as(ins.where(F.col("split") == "test"), "full_test")
    if oos_id is not None:
        oos = corpus.where(F.col("intent_id") == F.lit(oos_id))
        train = train.unionByName(_as(oos.where(F.col("split") == "train"), "train"))
        full_val = full_val.unionByName(_as(oos.where(F.col("split") == "val"), "full_validation"))
        full_test = full_test.unionByName(_as(oos.where(F.col("split") == "test"), "full_test"))
    return train.unionByName(fval).unionByName(ftest).unionByName(full_val).unionByName(full_test)


# ASM-01 ---------------------------------------------------------------------------
def assemble(config: str, exp_type: str, corpus: DataFrame, k: int = 10, oos_id=None,
             dataset_oos_id=None, generated=None, relabelled=None, mixed=None,
             num_labels=None, attr=None, attrs=None, fallback=None) -> DataFrame:
    """Dispatch on the dataset config: ``few_pure``, ``full``, ``full_<domain>``,
    else the generic reader ``fallback()``."""
    if config == "few_pure":
        if exp_type == "gpt3mix":
            return few_pure_mixed(corpus, mixed, num_labels, oos_id, dataset_oos_id)
        return few_pure(corpus, exp_type, k, oos_id, dataset_oos_id, generated, relabelled, attr)
    if config == "full":
        return full(corpus, exp_type, oos_id, generated, attrs)
    if config.startswith("full_"):
        return full_domain(corpus, config.split("_", 1)[1], exp_type, k, oos_id, generated, attr)
    if fallback is None:
        raise ValueError(f"unknown dataset config {config!r}")
    return fallback()


# ASM-11 ---------------------------------------------------------------------------
def get_split(assembled: DataFrame, name: str) -> DataFrame:
    return assembled.where(F.col("split") == name).drop("split")
