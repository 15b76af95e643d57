"""Experiment tables: grids, run selection, metric extraction, per-run means,
the performance hierarchy, summaries, t-tests against the largest model,
publication tables and the plot frame.

Inputs are long tables:
``runs(folder, dataset, config, oos_id, exp_type, engine, temp, run)`` and
``run_results(folder, scope, key, value)`` (``scope`` null for flat results).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.operators.metrics import pct_text

ROUND = 6
P_DIGITS = 4
# The dataset order of the publication table and its metrics.
ALL_DATASETS = ["clinc_oos", "hwu64", "banking77", "snips_official"]
ALL_METRICS = ["IA", "OR"]

# Which stored result feeds which reported metric.
# (setting, dataset or '*', needs an OOS id, source scope, source key, scope, metric)
METRIC_RULES = [
    ("flat", "*", False, None, "test_accuracy", "test", "A"),
    ("flat", "*", False, None, "valid_accuracy", "val", "A"),
    ("flat", "*", True, None, "test_inscope_accuracy", "test", "IA"),
    ("flat", "*", True, None, "valid_inscope_accuracy", "val", "IA"),
    ("flat", "*", True, None, "test_oos_recall", "test", "OR"),
    ("flat", "*", True, None, "valid_oos_recall", "val", "OR"),
    ("ex2", "snips_official", False, "overall", "test_accuracy", "overall", "IA"),
    ("ex2", "snips_official", False, "overall", "valid_accuracy", "overall_val", "IA"),
    ("ex2", "clinc_oos", False, "overall", "test_inscope_accuracy", "overall", "IA"),
    ("ex2", "clinc_oos", False, "overall", "valid_inscope_accuracy", "overall_val", "IA"),
    ("ex2", "clinc_oos", False, "overall", "test_oos_recall", "overall", "OR"),
    ("ex2", "clinc_oos", False, "overall", "valid_oos_recall", "overall_val", "OR"),
    ("ex2", "*", False, "few_shot", "test_accuracy", "few_shot", "IA"),
    ("ex2", "*", False, "few_shot", "valid_accuracy", "few_shot_val", "IA"),
]
RULE_SCHEMA = ("setting string, ds_rule string, needs_oos boolean, src_scope string, key string, "
               "scope string, metric string")


# Classes and out-of-scope id of each dataset, the domains that settings of one held-in domain go over.
DATASETS = {"clinc_oos": (151, 150), "banking77": (77, None), "hwu64": (64, None), "snips_official": (7, None)}
DOMAINS = {
    "clinc_oos": ["banking", "credit_card", "dining", "home", "auto", "travel", "utility", "work", "small_talk", "meta"],
    "snips_official": ["AddToPlaylist", "BookRestaurant", "GetWeather", "PlayMusic", "RateBook", "SearchCreativeWork",
                       "SearchScreeningEvent"],
}
ENGINES = ["ada", "babbage", "curie", "davinci", "gptj"]

# The named experiment groups.
# (name, dataset, config, exp types, engines, temperature, runs, learning rate, batch size, epochs, weight decay)
EXPERIMENT_GROUPS = [
    ("baselines", "clinc_oos", "few_pure", ["baseline"], None, None, 10, 4e-5, 32, 6, 0.01),
    ("ex2_setup", "clinc_oos", "full_*", ["gpt3"], ENGINES, "1.0", 10, 5e-5, 64, 10, 0.01),
    ("fewshot_baseline_clinc", "clinc_oos", "few_pure", ["baseline"], None, None, 10, 3e-5, 8, 6, 0.001),
    ("fewshot_oracle_clinc", "clinc_oos", "few_pure", ["gpt3_oracle"], ENGINES, "1.0", 10, 5e-5, 64, 6, 0.01),
    ("fewshot_gpt3_clinc", "clinc_oos", "few_pure", ["gpt3"], ENGINES, "1.0", 10, 5e-5, 64, 6, 0.01),
    ("fewshot_gpt3mix_clinc", "clinc_oos", "few_pure", ["gpt3mix", "gpt3mix_oracle"], ["curie"], "1.0", 10, 5e-5, 64, 6, 0.01),
    ("fewshot_eda_clinc", "clinc_oos", "few_pure", ["eda", "eda_oracle"], None, None, 10, 5e-5, 64, 6, 0.01),
    ("banking77_baselines", "banking77", "full", ["baseline"], None, None, 10, 5e-5, 32, 10, 0.01),
    ("fewshot_baseline_banking77", "banking77", "few_pure", ["baseline"], None, None, 10, 3e-5, 8, 20, 0.001),
    ("fewshot_gpt3_banking77", "banking77", "few_pure", ["gpt3"], ENGINES, "1.0", 10, 5e-5, 32, 10, 0.01),
    ("fewshot_oracle_banking77", "banking77", "few_pure", ["gpt3_oracle"], ENGINES, "1.0", 10, 5e-5, 32, 10, 0.01),
    ("fewshot_eda_banking77", "banking77", "few_pure", ["eda", "eda_oracle"], None, None, 10, 5e-5, 32, 10, 0.01),
    ("hwu64_baselines", "hwu64", "full", ["intrinsic"], None, None, 10, 5e-5, 32, 6, 0.01),
    ("fewshot_baseline_hwu64", "hwu64", "few_pure", ["baseline"], None, None, 10, 3e-5, 8, 20, 0.001),
    ("fewshot_gpt3_hwu64", "hwu64", "few_pure", ["gpt3"], ENGINES, "1.0", 10, 3e-5, 32, 10, 0.01),
    ("fewshot_oracle_hwu64", "hwu64", "few_pure", ["gpt3_oracle"], ENGINES, "1.0", 10, 3e-5, 32, 10, 0.01),
    ("fewshot_eda_hwu64", "hwu64", "few_pure", ["eda", "eda_oracle"], None, None, 10, 3e-5, 32, 10, 0.01),
    ("snips_baselines", "snips_official", "full", ["baseline"], None, "1.0", None, 4e-5, 32, 6, 0.01),
    ("snips_ex2_setup", "snips_official", "full_*", ["gpt3"], ENGINES, "1.0", 10, 5e-5, 64, 10, 0.01),
    ("fewshot_baseline_snips", "snips_official", "few_pure", ["baseline"], None, None, 10, 3e-5, 8, 20, 0.001),
    ("fewshot_gpt3_snips", "snips_official", "few_pure", ["gpt3"], ENGINES, "1.0", 10, 5e-5, 64, 10, 0.01),
    ("fewshot_oracle_snips", "snips_official", "few_pure", ["gpt3_oracle"], ENGINES, "1.0", 10, 5e-5, 64, 10, 0.01),
    ("fewshot_eda_snips", "snips_official", "few_pure", ["eda", "eda_oracle"], None, None, 10, 5e-5, 64, 10, 0.01),
]
GROUP_SCHEMA = ("exp_group string, dataset string, num_labels int, oos_id int, config array<string>, exp_type array<string>, "
                "engine array<string>, temp string, run array<int>, lr double, batch_size int, epochs int, weight_decay double")
RUN_KEYS = ["dataset", "config", "exp_type", "engine", "temp", "run"]


# RES-01 ----------------------------------------------------------------------------
def experiment_grid(base: DataFrame, params: dict[str, Sequence]) -> DataFrame:
    """Cartesian product of ``base`` rows with list-valued parameters (one
    generator per parameter, no join), plus a stable ``config_id``."""
    out = base
    for name, values in params.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in out.columns]
    return out.withColumn("config_id", F.sha1(F.concat_ws("|", *keys)))


def experiment_groups(spark: SparkSession, names: Sequence[str] | None = None,
                      domains: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The experiments of the named groups (all by default), a row each. ``full_*`` stands for one config per domain of the
    dataset, from ``domains`` or ``DOMAINS``; a group without engines or runs has nulls there. Unknown names raise."""
    unknown = set(names or ()) - {g[0] for g in EXPERIMENT_GROUPS}
    if unknown:
        raise KeyError(f"no such experiment group: {sorted(unknown)}")
    rows = []
    for name, ds, config, types, engines, temp, runs, *training in EXPERIMENT_GROUPS:
        if names is None or name in names:
            configs = [f"full_{d}" for d in (domains or DOMAINS)[ds]] if config == "full_*" else [config]
            rows.append((name, ds, *DATASETS[ds], configs, types, engines or [None], temp,
                         [None] if runs is None else list(range(runs)), *training))
    out = spark.createDataFrame(rows, GROUP_SCHEMA)
    for c in ("config", "exp_type", "engine", "run"):
        out = out.withColumn(c, F.explode(c))
    return out


def group_progress(groups: DataFrame, runs: DataFrame) -> DataFrame:
    """Per experiment group: ``n_experiments``, how many of them have a run folder (``n_done``), and ``n_folders``."""
    found = runs.groupBy(*RUN_KEYS).agg(F.count(F.lit(1)).alias("n"))
    same = [groups[c].eqNullSafe(found[c]) for c in RUN_KEYS]
    return (groups.join(found, same, "left").groupBy("exp_group")
            .agg(F.count(F.lit(1)).alias("n_experiments"), F.count("n").alias("n_done"),
                 F.coalesce(F.sum("n"), F.lit(0)).alias("n_folders")))


# RES-02 ----------------------------------------------------------------------------
def exp_key(exp_type: Column, engine: Column, temp: Column) -> Column:
    return F.when(exp_type.contains("gpt"), F.concat_ws("_", exp_type, engine, temp)).otherwise(exp_type)


def select_runs(runs: DataFrame, datasets=None, augmentation=None, temps=None,
                skip_oracle: bool = False) -> DataFrame:
    r = runs.withColumn("exp_key", exp_key(F.col("exp_type"), F.col("engine"), F.col("temp")))
    if datasets:
        r = r.where(F.col("dataset").isin(list(datasets)))
    gpt = F.col("exp_type").contains("gpt")
    if augmentation:
        aug = F.when(gpt, F.col("engine")).otherwise(F.regexp_replace("exp_type", "_oracle", ""))
        r = r.where(aug.isin(list(augmentation)))
    if temps:
        r = r.where(~gpt | F.col("temp").isin([str(t) for t in temps]))
    if skip_oracle:
        r = r.where(~F.col("exp_key").contains("oracle"))
    return r


# RES-03 ----------------------------------------------------------------------------
def runs_per_config(selected: DataFrame) -> DataFrame:
    return selected.groupBy("exp_key", "dataset").agg(F.countDistinct("run").alias("n_runs"))


# RES-04 ----------------------------------------------------------------------------
def setting_of(config: Column, exp_type: Column) -> Column:
    flat = (config == "few_pure") | (~config.startswith("full_") & (exp_type == "baseline"))
    return F.when(flat, "flat").otherwise("ex2")


def extract_metrics(spark: SparkSession, selected: DataFrame, results: DataFrame) -> DataFrame:
    """Stored results -> ``(exp_key, dataset, run, folder, scope, metric, value)`` by the rule table."""
    rules = F.broadcast(spark.createDataFrame(METRIC_RULES, RULE_SCHEMA).select(  # fixed 14 rows
        F.col("setting").alias("r_setting"), F.col("ds_rule").alias("r_ds"), F.col("needs_oos").alias("r_oos"),
        F.coalesce(F.col("src_scope"), F.lit("")).alias("r_src"), F.col("key").alias("r_key"),
        F.col("scope").alias("r_scope"), F.col("metric")))
    r = selected.withColumn("r_setting", setting_of(F.col("config"), F.col("exp_type")))
    res = results.select("folder", F.coalesce(F.col("scope"), F.lit("")).alias("r_src"),
                         F.col("key").alias("r_key"), "value")
    j = r.join(res, "folder").join(rules, ["r_setting", "r_key", "r_src"])
    ok = ((F.col("r_ds") == "*") | (F.col("r_ds") == F.col("dataset"))) & \
        (~F.col("r_oos") | F.col("oos_id").isNotNull())
    return j.where(ok).select("exp_key", "dataset", "run", "folder", F.col("r_scope").alias("scope"),
                              "metric", "value")


# RES-05 / RES-06 ---------------------------------------------------------------------
def run_means(metrics: DataFrame) -> DataFrame:
    """Mean of 100 x value over the folders of one run; NaN and null dropped after."""
    m = metrics.groupBy("exp_key", "dataset", "run", "scope", "metric").agg(
        F.avg(F.col("value") * 100.0).alias("value"))
    return m.where(F.col("value").isNotNull() & ~F.isnan("value"))


# RES-07 ----------------------------------------------------------------------------
def performance(means: DataFrame) -> DataFrame:
    """``exp_key -> dataset -> scope -> metric -> [run values]`` (runs in order)."""
    return (means.groupBy("exp_key", "dataset", "scope", "metric")
            .agg(F.sort_array(F.collect_list(F.struct("run", "value"))).alias("_v"))
            .select("exp_key", "dataset", "scope", "metric",
                    F.transform("_v", lambda x: F.round(x["value"], ROUND)).alias("values")))


# RES-08 ----------------------------------------------------------------------------
def summary(means: DataFrame) -> DataFrame:
    """Mean and population deviation per (exp_key, dataset, scope, metric)."""
    return (means.groupBy("exp_key", "dataset", "scope", "metric")
            .agg(F.round(F.avg("value"), ROUND).alias("mean"),
                 F.round(F.stddev_pop("value"), ROUND).alias("std"),
                 F.count(F.lit(1)).alias("n_runs")))


def summary_text(s: DataFrame) -> DataFrame:
    """Mean and deviation with two decimals, rounded half-up, e.g. ``81.25 (0.50)``; both are at least 0."""
    return s.withColumn("text", F.concat(pct_text(F.col("mean") / 100.0), F.lit(" ("), pct_text(F.col("std") / 100.0), F.lit(")")))


def summary_pivot(s: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """Scope x metric view; the scope list bounds the pivot."""
    return (summary_text(s).groupBy("exp_key", "dataset", "metric").pivot("scope", list(scopes))
            .agg(F.first("text")))


# RES-09 ----------------------------------------------------------------------------
#: Steps of the continued fraction; 50 reach 1e-12 up to a million degrees of freedom.
BETA_STEPS = 100


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, by a fixed number of modified Lentz steps."""
    def safe(v):
        return F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def half(acc, term):
        d = 1.0 / safe(1.0 + term * acc["d"])
        c = safe(1.0 + term / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    def step(acc, m):
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # each half enters the next as the element of a one-element array, so that it is computed once
        first = F.aggregate(F.array(acc), acc, lambda _, e: half(e, even))
        return F.aggregate(F.array(first), acc, lambda _, e: half(e, odd))

    d = 1.0 / safe(1.0 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(BETA_STEPS)), start, step)["h"]


def _log_gamma_half_step(a: Column) -> Column:
    """ln gamma(a + 1/2) - ln gamma(a) for a > 0: the asymptotic series eight steps further on, carried back."""
    z = a + 8.0
    series = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, 3)) - 1 / (640 * F.pow(z, 5)) + 17 / (14336 * F.pow(z, 7))
    back = F.lit(0.0)
    for i in range(8):
        back = back + F.log((a + i + 0.5) / (a + i))
    return series - back


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for ``df`` >= 1, the incomplete beta function I(df / (df + t^2); df / 2, 1 / 2)."""
    t, df = t.cast("double"), df.cast("double")
    a, half = df / 2, F.lit(0.5)
    x, y = df / (df + t * t), t * t / (df + t * t)
    log_front = -a * F.log1p(t * t / df) + F.log(y) / 2 + _log_gamma_half_step(a) - math.log(math.pi) / 2
    near = F.exp(log_front) * _beta_fraction(a, half, x) / a
    far = 1.0 - F.exp(log_front) * _beta_fraction(half, a, y) / half
    return F.when(df >= 1, F.when(t == 0, 1.0).when(x < (a + 1) / (a + 2.5), near).otherwise(far))


def ttest_vs_largest(means: DataFrame, largest: str = "davinci") -> DataFrame:
    """Equal-variance two-sample t-test of each model against the largest one,
    per dataset, scope and metric, separately for oracle and plain settings."""
    fam = F.when(F.col("exp_key").contains("oracle"), "oracle").otherwise("plain")
    st = (means.withColumn("family", fam)
          .groupBy("family", "exp_key", "dataset", "scope", "metric")
          .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")))
    big_key = (st.where(F.col("exp_key").contains(largest)).groupBy("family")
               .agg(F.max("exp_key").alias("base_key")))
    big = st.join(big_key, "family").where(F.col("exp_key") == F.col("base_key")).select(
        "family", "dataset", "scope", "metric", "base_key",
        F.col("n").alias("n1"), F.col("m").alias("m1"), F.col("v").alias("v1"))
    other = st.join(big_key, "family").where(F.col("exp_key") != F.col("base_key")).drop("base_key")
    j = other.join(big, ["family", "dataset", "scope", "metric"])
    df = F.col("n1") + F.col("n") - 2
    sp2 = ((F.col("n1") - 1) * F.coalesce("v1", F.lit(0.0)) + (F.col("n") - 1) * F.coalesce("v", F.lit(0.0))) / df
    t = (F.col("m1") - F.col("m")) / F.sqrt(sp2 * (1.0 / F.col("n1") + 1.0 / F.col("n")))
    j = j.withColumn("df", df.cast("int")).withColumn("t", F.when((df > 0) & (sp2 > 0), t))
    return j.select("family", "dataset", "scope", "metric", "base_key", F.col("exp_key").alias("model"),
                    F.round("t", ROUND).alias("t"), "df",
                    F.round(t_two_sided_p(F.col("t"), F.col("df")), P_DIGITS).alias("p"))


# RES-10 ----------------------------------------------------------------------------
def publication_table(s: DataFrame, scopes: Sequence[str], datasets: Sequence[str] = ALL_DATASETS) -> DataFrame:
    """Cells in reporting order: dataset (fixed order) x scope x [IA, OR]; A
    stands in for a missing IA; a missing OR is skipped."""
    ds_pos = F.array_position(F.array(*[F.lit(d) for d in datasets]), F.col("dataset"))
    sc_pos = F.array_position(F.array(*[F.lit(x) for x in scopes]), F.col("scope"))
    have = (s.groupBy("exp_key", "dataset", "scope")
            .agg(F.max(F.when(F.col("metric") == "IA", 1).otherwise(0)).alias("has_ia")))
    x = s.join(have, ["exp_key", "dataset", "scope"])
    shown = F.when(F.col("metric") == "IA", "IA").when(F.col("metric") == "OR", "OR") \
        .when((F.col("metric") == "A") & (F.col("has_ia") == 0), "IA")
    x = (x.withColumn("shown", shown).where(F.col("shown").isNotNull() & (ds_pos > 0) & (sc_pos > 0))
         .withColumn("col_key", (ds_pos * 1000 + sc_pos * 10
                     + F.when(F.col("shown") == "IA", 0).otherwise(1)).cast("int")))
    return x.select("exp_key", "dataset", "scope", "shown", "col_key",
                    F.regexp_replace(F.regexp_replace("exp_key", "_1.0", ""), "_", "\\\\_").alias("row_label"),
                    F.format_string("%.2f (%.2f)", F.col("mean"), F.col("std")).alias("cell"))


# RES-11 ----------------------------------------------------------------------------
def plot_frame(means: DataFrame, fidelity: DataFrame, engine: str = "gptj") -> DataFrame:
    """``(temp, ds, val_acc_mean, val_acc_std, fidelity)`` for one engine's temperature sweep.

    ``fidelity``: ``(ds, attr, fidelity)``; accuracy is IA for the dataset with an
    OOS class (clinc_oos) and A otherwise, on the val scope.
    """
    acc = F.when(F.col("dataset") == "clinc_oos", "IA").otherwise("A")
    m = (means.where(F.col("exp_key").startswith(f"gpt3_{engine}_") & (F.col("scope") == "val")
                     & (F.col("metric") == acc))
         .withColumn("temp", F.substring_index("exp_key", "_", -1))
         .groupBy("temp", F.col("dataset").alias("ds"))
         .agg(F.round(F.avg("value"), ROUND).alias("val_acc_mean"),
              F.round(F.stddev_pop("value"), ROUND).alias("val_acc_std")))
    f = (fidelity.where(F.col("attr").startswith(f"{engine}_"))
         .select("ds", F.substring_index("attr", "_", -1).alias("temp"), "fidelity"))
    return m.join(f, ["ds", "temp"], "left").select(F.col("temp").cast("double").alias("temp"), "ds",
                                                    "val_acc_mean", "val_acc_std", "fidelity")


def thresholds(fidelity: DataFrame) -> DataFrame:
    return fidelity.where(F.col("attr") == "threshold").select("ds", F.col("fidelity").alias("threshold"))


_ = Window
