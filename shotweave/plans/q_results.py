"""Registered experiment-table queries (RES-*) with their oracles.

Run folders and their stored results are derived from ``events``: each user
is a run folder (dataset, setting, run number from the user id), and the
user's events are its stored metric values (metric from the event type,
test/valid from the event id, value / 500). Some folders carry NaN.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shotweave.operators import results as R
from shotweave.plans.catalog import register
from shotweave.sources.corpus import corpus, load_table

DATASETS = ["clinc_oos", "hwu64", "banking77", "snips_official"]
EXP = [("baseline", None, None), ("eda", None, None), ("gpt3", "ada", "1.0"), ("gpt3", "davinci", "1.0"),
       ("gpt3_oracle", "davinci", "1.0"), ("gpt3_oracle", "ada", "1.0")]
SCOPES = ["test", "overall", "few_shot"]
ALL_SCOPES = ["test", "val", "overall", "overall_val", "few_shot", "few_shot_val"]


def _arr(values):
    return F.array(*[F.lit(v).cast("string") for v in values])


def run_tables(spark, sf):
    ev = load_table(spark, sf, "events")
    u = F.col("user_id")
    v = (F.floor(u / 4) % 6).cast("int") + 1
    a = F.floor(u / 24)
    runs = (ev.select("user_id").distinct().select(
        F.concat(F.lit("run-"), u.cast("string")).alias("folder"),
        F.element_at(_arr(DATASETS), (u % 4 + 1).cast("int")).alias("dataset"),
        F.element_at(_arr([e[0] for e in EXP]), v).alias("exp_type"),
        F.element_at(_arr([e[1] for e in EXP]), v).alias("engine"),
        F.element_at(_arr([e[2] for e in EXP]), v).alias("temp"),
        F.when(a % 2 == 0, F.lit("few_pure")).otherwise(
            F.concat(F.lit("full_"), F.element_at(_arr(DATASETS), (u % 4 + 1).cast("int")))).alias("config"),
        ((F.floor(a / 2)) % 3).cast("int").alias("run"),
        F.when(u % 4 == 0, F.lit(150)).alias("oos_id")))
    metric = (F.when(F.col("event_type") == "click", "accuracy").when(F.col("event_type") == "view", "inscope_accuracy")
              .when(F.col("event_type") == "purchase", "oos_recall").when(F.col("event_type") == "signup", "f1")
              .otherwise("recall"))
    prefix = F.when(F.col("event_id") % 2 == 0, "test").otherwise("valid")
    val = F.when((F.col("event_type") == "purchase") & (u % 23 == 0), F.lit(float("nan"))) \
        .otherwise(F.col("value") / 500.0)
    e = ev.select(F.concat(F.lit("run-"), u.cast("string")).alias("folder"), "event_id",
                  F.concat(prefix, F.lit("_"), metric).alias("key"), val.alias("value"))
    res = (e.join(runs.select("folder", "config"), "folder")
           .withColumn("scope", F.when(F.col("config") == "few_pure", F.lit(None).cast("string"))
                       .when(F.floor(F.col("event_id") / 2) % 2 == 0, "overall").otherwise("few_shot"))
           .groupBy("folder", "scope", "key").agg(F.avg("value").alias("value")))
    return runs, res


def _lst(values):
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in values) + "]"


RUNS_SQL = f"""
WITH runs AS (
  SELECT 'run-' || CAST(user_id AS VARCHAR) AS folder,
         {_lst(DATASETS)}[user_id % 4 + 1] AS dataset,
         {_lst([e[0] for e in EXP])}[(user_id // 4) % 6 + 1] AS exp_type,
         {_lst([e[1] for e in EXP])}[(user_id // 4) % 6 + 1] AS engine,
         {_lst([e[2] for e in EXP])}[(user_id // 4) % 6 + 1] AS temp,
         CASE WHEN (user_id // 24) % 2 = 0 THEN 'few_pure' ELSE 'full_' || {_lst(DATASETS)}[user_id % 4 + 1] END AS config,
         CAST(((user_id // 24) // 2) % 3 AS INTEGER) AS run,
         CASE WHEN user_id % 4 = 0 THEN 150 END AS oos_id
  FROM (SELECT DISTINCT user_id FROM events) u
), res AS (
  SELECT e.folder, CASE WHEN r.config = 'few_pure' THEN NULL WHEN (e.event_id // 2) % 2 = 0 THEN 'overall'
                        ELSE 'few_shot' END AS scope, e.key, avg(e.value) AS value
  FROM (SELECT 'run-' || CAST(user_id AS VARCHAR) AS folder, event_id,
               CASE WHEN event_id % 2 = 0 THEN 'test' ELSE 'valid' END || '_' ||
               CASE event_type WHEN 'click' THEN 'accuracy' WHEN 'view' THEN 'inscope_accuracy'
                    WHEN 'purchase' THEN 'oos_recall' WHEN 'signup' THEN 'f1' ELSE 'recall' END AS key,
               CASE WHEN event_type = 'purchase' AND user_id % 23 = 0 THEN 'NaN'::DOUBLE ELSE value / 500.0 END AS value
        FROM events) e JOIN runs r USING (folder)
  GROUP BY ALL
), sel AS (
  SELECT *, CASE WHEN contains(exp_type, 'gpt') THEN concat_ws('_', exp_type, engine, temp) ELSE exp_type END AS exp_key
  FROM runs
), rules AS (
  SELECT * FROM (VALUES {", ".join("(" + ", ".join("NULL" if x is None else (str(x).upper() if isinstance(x, bool) else f"'{x}'") for x in r) + ")" for r in R.METRIC_RULES)})
  t(setting, ds_rule, needs_oos, src_scope, key, scope, metric)
), metrics AS (
  SELECT s.exp_key, s.dataset, s.run, s.folder, ru.scope, ru.metric, x.value
  FROM sel s JOIN res x USING (folder)
  JOIN rules ru ON ru.setting = CASE WHEN s.config = 'few_pure' OR (NOT starts_with(s.config, 'full_') AND s.exp_type = 'baseline')
                                     THEN 'flat' ELSE 'ex2' END
               AND ru.key = x.key AND coalesce(ru.src_scope, '') = coalesce(x.scope, '')
  WHERE (ru.ds_rule = '*' OR ru.ds_rule = s.dataset) AND (NOT ru.needs_oos OR s.oos_id IS NOT NULL)
), means AS (
  SELECT * FROM (SELECT exp_key, dataset, run, scope, metric, avg(value * 100.0) AS value
                 FROM metrics GROUP BY ALL) t
  WHERE value IS NOT NULL AND NOT isnan(value)
)
"""


def _means(spark, sf):
    runs, res = run_tables(spark, sf)
    sel = R.select_runs(runs)
    return R.run_means(R.extract_metrics(spark, sel, res))


@register("res01_experiment_grid", """
WITH d AS (SELECT DISTINCT 'full_' || lang AS config FROM documents)
SELECT config, exp_type, CAST(run AS INTEGER) AS run,
       sha1(concat_ws('|', config, exp_type, CAST(run AS VARCHAR))) AS config_id
FROM d, (SELECT unnest(['baseline', 'upsample', 'eda']) AS exp_type) e, (SELECT unnest(range(10)) AS run) r""")
def q_res01(spark, sf):
    base = corpus(spark, sf).where(F.col("intent") != "oos").select(
        F.concat(F.lit("full_"), F.col("domain")).alias("config")).distinct()
    return R.experiment_grid(base, {"exp_type": ["baseline", "upsample", "eda"], "run": list(range(10))})


def _groups_sql() -> str:
    def lit(x):
        return "NULL" if x is None else f"'{x}'"

    rows = []
    for name, ds, config, types, engines, temp, runs, *_ in R.EXPERIMENT_GROUPS:
        configs = f"['full_{ds}']" if config == "full_*" else _lst([config])
        run = "[NULL::INTEGER]" if runs is None else f"CAST(range({runs}) AS INTEGER[])"
        rows.append(f"({lit(name)}, {lit(ds)}, {configs}, {_lst(types)}, {_lst(engines or [None])}::VARCHAR[], "
                    f"{lit(temp)}::VARCHAR, {run})")
    return f"""
, g0(exp_group, dataset, configs, types, engines, temp, runs) AS (VALUES {", ".join(rows)})
, g1 AS (SELECT exp_group, dataset, unnest(configs) AS config, types, engines, temp, runs FROM g0)
, g2 AS (SELECT exp_group, dataset, config, unnest(types) AS exp_type, engines, temp, runs FROM g1)
, g3 AS (SELECT exp_group, dataset, config, exp_type, unnest(engines) AS engine, temp, runs FROM g2)
, g AS (SELECT exp_group, dataset, config, exp_type, engine, temp, unnest(runs) AS run FROM g3)
, found AS (SELECT dataset, config, exp_type, engine, temp, run, count(*) AS n FROM runs GROUP BY ALL)
SELECT g.exp_group, count(*) AS n_experiments, count(f.n) AS n_done, CAST(coalesce(sum(f.n), 0) AS BIGINT) AS n_folders
FROM g LEFT JOIN found f ON g.dataset = f.dataset AND g.config = f.config AND g.exp_type = f.exp_type
  AND g.engine IS NOT DISTINCT FROM f.engine AND g.temp IS NOT DISTINCT FROM f.temp AND g.run IS NOT DISTINCT FROM f.run
GROUP BY g.exp_group"""


@register("res01_experiment_groups", RUNS_SQL + _groups_sql())
def q_res01_groups(spark, sf):
    runs, _ = run_tables(spark, sf)
    return R.group_progress(R.experiment_groups(spark, domains={d: [d] for d in R.DATASETS}), runs)


@register("res02_select_runs", RUNS_SQL + """
SELECT folder, exp_key, dataset, run FROM sel
WHERE dataset IN ('clinc_oos', 'banking77')
  AND CASE WHEN contains(exp_type, 'gpt') THEN engine ELSE replace(exp_type, '_oracle', '') END IN ('davinci', 'eda')""")
def q_res02(spark, sf):
    runs, _ = run_tables(spark, sf)
    return R.select_runs(runs, datasets=["clinc_oos", "banking77"], augmentation=["davinci", "eda"]).select(
        "folder", "exp_key", "dataset", "run")


@register("res03_runs_per_config", RUNS_SQL + "SELECT exp_key, dataset, count(DISTINCT run) AS n_runs FROM sel GROUP BY ALL")
def q_res03(spark, sf):
    runs, _ = run_tables(spark, sf)
    return R.runs_per_config(R.select_runs(runs))


@register("res04_extract_metrics", RUNS_SQL + "SELECT exp_key, dataset, run, folder, scope, metric, round(value, 9) AS value FROM metrics")
def q_res04(spark, sf):
    runs, res = run_tables(spark, sf)
    m = R.extract_metrics(spark, R.select_runs(runs), res)
    return m.withColumn("value", F.round("value", 9))


@register("res05_run_means", RUNS_SQL + "SELECT exp_key, dataset, run, scope, metric, round(value, 9) AS value FROM means")
def q_res05(spark, sf):
    return _means(spark, sf).withColumn("value", F.round("value", 9))


@register("res07_performance", RUNS_SQL + """
SELECT exp_key, dataset, scope, metric, list(round(value, 6) ORDER BY run) AS values FROM means GROUP BY ALL""")
def q_res07(spark, sf):
    return R.performance(_means(spark, sf))


SUMMARY_SQL = """
, summ AS (
  SELECT exp_key, dataset, scope, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
         count(*) AS n_runs
  FROM means GROUP BY ALL)
"""


@register("res08_summary", RUNS_SQL + SUMMARY_SQL + "SELECT * FROM summ")
def q_res08(spark, sf):
    return R.summary(_means(spark, sf))


def _text_sql(x: str) -> str:
    h = f"CAST(round({x} / 100.0 * 10000.0) AS BIGINT)"
    return f"CAST({h} // 100 AS VARCHAR) || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0')"


@register("res08_scope_view", RUNS_SQL + SUMMARY_SQL + ", texts AS (SELECT *, " + _text_sql("mean") + " || ' (' || "
          + _text_sql("std") + " || ')' AS text FROM summ) SELECT exp_key, dataset, metric, "
          + ", ".join(f"max(text) FILTER (WHERE scope = '{s}') AS {s}" for s in ALL_SCOPES)
          + " FROM texts GROUP BY exp_key, dataset, metric")
def q_res08_view(spark, sf):
    return R.summary_pivot(R.summary(_means(spark, sf)), ALL_SCOPES)


def _p_sql(t: str, df: str) -> str:
    th = f"atan(abs({t}) / sqrt({df}))"
    c2 = f"pow(cos({th}), 2)"
    even = (f"list_reduce(range(1, greatest(({df} - 2) // 2, 0) + 1), lambda acc, j: "
            f"{{'s': acc.s + acc.t * (2 * j - 1) / (2 * j) * {c2}, 't': acc.t * (2 * j - 1) / (2 * j) * {c2}}}, "
            f"{{'s': 1.0::DOUBLE, 't': 1.0::DOUBLE}}).s")
    odd = (f"list_reduce(range(1, greatest(({df} - 3) // 2, 0) + 1), lambda acc, j: "
           f"{{'s': acc.s + acc.t * (2 * j) / (2 * j + 1) * {c2}, 't': acc.t * (2 * j) / (2 * j + 1) * {c2}}}, "
           f"{{'s': 1.0::DOUBLE, 't': 1.0::DOUBLE}}).s")
    a = (f"CASE WHEN {df} % 2 = 0 THEN sin({th}) * {even} WHEN {df} = 1 THEN 2.0 * {th} / pi() "
         f"ELSE 2.0 / pi() * ({th} + sin({th}) * cos({th}) * {odd}) END")
    return f"CASE WHEN {df} >= 1 THEN 1.0 - ({a}) END"


@register("res09_ttest", RUNS_SQL + f"""
, st AS (
  SELECT CASE WHEN contains(exp_key, 'oracle') THEN 'oracle' ELSE 'plain' END AS family, exp_key, dataset, scope, metric,
         count(*) AS n, avg(value) AS m, var_samp(value) AS v
  FROM means GROUP BY ALL
), bk AS (SELECT family, max(exp_key) AS base_key FROM st WHERE contains(exp_key, 'davinci') GROUP BY family),
big AS (SELECT st.family, dataset, scope, metric, base_key, n AS n1, m AS m1, v AS v1 FROM st JOIN bk USING (family)
        WHERE exp_key = base_key),
oth AS (SELECT st.* FROM st JOIN bk USING (family) WHERE exp_key <> base_key),
j AS (
  SELECT o.family, o.dataset, o.scope, o.metric, b.base_key, o.exp_key AS model, CAST(b.n1 + o.n - 2 AS INTEGER) AS df,
         ((b.n1 - 1) * coalesce(b.v1, 0.0) + (o.n - 1) * coalesce(o.v, 0.0)) / (b.n1 + o.n - 2) AS sp2,
         b.m1, o.m, b.n1, o.n
  FROM oth o JOIN big b USING (family, dataset, scope, metric)
), tt AS (
  SELECT *, CASE WHEN df > 0 AND sp2 > 0 THEN (m1 - m) / sqrt(sp2 * (1.0 / n1 + 1.0 / n)) END AS t FROM j
)
SELECT family, dataset, scope, metric, base_key, model, round(t, 6) AS t, df, round({_p_sql('t', 'df')}, 4) AS p FROM tt""")
def q_res09(spark, sf):
    return R.ttest_vs_largest(_means(spark, sf))


@register("res10_publication_table", RUNS_SQL + SUMMARY_SQL + f"""
, hv AS (SELECT exp_key, dataset, scope, max(CASE WHEN metric = 'IA' THEN 1 ELSE 0 END) AS has_ia FROM summ GROUP BY ALL),
x AS (
  SELECT s.*, CASE WHEN metric = 'IA' THEN 'IA' WHEN metric = 'OR' THEN 'OR'
                   WHEN metric = 'A' AND has_ia = 0 THEN 'IA' END AS shown,
         list_position({_lst(R.ALL_DATASETS)}, s.dataset) AS dp, list_position({_lst(SCOPES)}, s.scope) AS sp
  FROM summ s JOIN hv USING (exp_key, dataset, scope)
)
SELECT exp_key, dataset, scope, shown, CAST(dp * 1000 + sp * 10 + CASE WHEN shown = 'IA' THEN 0 ELSE 1 END AS INTEGER) AS col_key,
       replace(replace(exp_key, '_1.0', ''), '_', '\\_') AS row_label, printf('%.2f (%.2f)', mean, std) AS cell
FROM x WHERE shown IS NOT NULL AND dp > 0 AND sp > 0""")
def q_res10(spark, sf):
    return R.publication_table(R.summary(_means(spark, sf)), SCOPES)


# Fidelity per dataset for the plot frame, derived from the same events: the
# mean scaled value of 'view' events stands for the generator's fidelity and
# that of 'click' events for the validation threshold.
FID_SQL = f"""
, fid AS (
  SELECT {_lst(DATASETS)}[user_id % 4 + 1] AS ds, 'ada_1.0' AS attr, round(avg(value / 500.0), 9) AS fidelity
  FROM events WHERE event_type = 'view' GROUP BY 1
  UNION ALL
  SELECT {_lst(DATASETS)}[user_id % 4 + 1], 'threshold', round(avg(value / 500.0), 9)
  FROM events WHERE event_type = 'click' GROUP BY 1
)
"""


def _fidelity(spark, sf):
    ev = load_table(spark, sf, "events")
    ds = F.element_at(_arr(DATASETS), (F.col("user_id") % 4 + 1).cast("int")).alias("ds")
    gen = (ev.where(F.col("event_type") == "view").groupBy(ds)
           .agg(F.round(F.avg(F.col("value") / 500.0), 9).alias("fidelity")).withColumn("attr", F.lit("ada_1.0")))
    thr = (ev.where(F.col("event_type") == "click").groupBy(ds)
           .agg(F.round(F.avg(F.col("value") / 500.0), 9).alias("fidelity")).withColumn("attr", F.lit("threshold")))
    return gen.unionByName(thr)


@register("res11_plot_frame", RUNS_SQL + FID_SQL + """
, m AS (
  SELECT string_split(exp_key, '_')[-1] AS temp, dataset AS ds, round(avg(value), 6) AS val_acc_mean,
         round(stddev_pop(value), 6) AS val_acc_std
  FROM means
  WHERE starts_with(exp_key, 'gpt3_ada_') AND scope = 'val'
    AND metric = CASE WHEN dataset = 'clinc_oos' THEN 'IA' ELSE 'A' END
  GROUP BY ALL
)
SELECT CAST(m.temp AS DOUBLE) AS temp, m.ds, m.val_acc_mean, m.val_acc_std, f.fidelity
FROM m LEFT JOIN (SELECT ds, string_split(attr, '_')[-1] AS temp, fidelity FROM fid WHERE starts_with(attr, 'ada_')) f
  USING (ds, temp)""")
def q_res11(spark, sf):
    return R.plot_frame(_means(spark, sf), _fidelity(spark, sf), engine="ada")


@register("res11_thresholds", FID_SQL.replace(", fid AS (", "WITH fid AS (", 1) + """
SELECT ds, fidelity AS threshold FROM fid WHERE attr = 'threshold'""")
def q_res11t(spark, sf):
    return R.thresholds(_fidelity(spark, sf))
