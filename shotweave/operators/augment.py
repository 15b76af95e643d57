"""Augmentation: prompts, upsampling, request plans, completion acceptance,
the attribute grid, resume, and the user generator hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.functions.text import STRIPPED, py_strip
from shotweave.sources.tables import durable

# Prompt wording (header, line prefix) and the sweep grid.
PROMPT_HEADER = "The following sentences belong to the same category '{intent}':"
LINE_PREFIX = "Example {i}: "
ENGINES = ["ada", "babbage", "curie", "davinci"]
SWEEP_TEMPS = ["0.5", "0.6", "0.7", "0.8", "0.9", "1.0", "1.1", "1.2", "1.3", "1.4",
               "1.5", "1.6", "1.7", "1.8", "1.9", "2.0"]
DEFAULT_TEMPS = ["1.0"]
N_MAX = 128  # request size cap

GEN_COLS = ["domain", "attr", "intent", "intent_id", "prompt_id", "gen_idx", "text"]


def safe_range(n: Column) -> Column:
    """0..n-1, empty for n <= 0 (Spark's ``sequence(0, -1)`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(
        F.array().cast("array<int>"))


def _line_prefix(i: Column) -> Column:
    before, after = LINE_PREFIX.split("{i}")
    return F.concat(F.lit(before), i.cast("string"), F.lit(after))


# AUG-01 --------------------------------------------------------------------
def build_prompts(seeds: DataFrame, num_ex: int = 10) -> DataFrame:
    """Chunks of ``num_ex`` seeds per intent (in hash-rank order) rendered as prompts.

    ``seeds`` needs ``intent, intent_id, domain, rn, text``. A chunk has at most
    ``num_ex`` rows, so collecting it is bounded. Output:
    ``domain, intent, intent_id, prompt_id, lines ARRAY<STRING>, prompt``
    where ``lines`` are the seed texts and ``prompt`` the rendered text.
    """
    chunked = seeds.withColumn("prompt_id", F.floor((F.col("rn") - 1) / num_ex).cast("int"))
    g = (chunked.groupBy("domain", "intent", "intent_id", "prompt_id")
         .agg(F.sort_array(F.collect_list(F.struct("rn", "text"))).alias("_s")))
    lines = F.transform(F.col("_s"), lambda x: x["text"])
    before, after = PROMPT_HEADER.split("{intent}")
    body = F.array_join(
        F.transform(F.col("_s"), lambda x, i: F.concat(_line_prefix(i + 1), x["text"])), "\n")
    header = F.concat(F.lit(before), F.col("intent"), F.lit(after))
    prompt = F.concat_ws("\n", header, body, F.rtrim(_line_prefix(F.lit(num_ex + 1))))
    return g.select("domain", "intent", "intent_id", "prompt_id",
                    lines.alias("lines"), prompt.alias("prompt"))


def prompt_lines(prompts: DataFrame, scaffold: bool = False) -> Column:
    """Lines an augmenter works on: the seeds, or (``scaffold``) every prompt line."""
    if scaffold:
        return F.split(F.trim(F.col("prompt")), "\n")
    return F.col("lines")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as the session has shuffle partitions, however few its bytes are: for
    rows that mean much work each, which adaptive coalescing can't know."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def emit_blocks(df: DataFrame, count: Column, block: int, *keys: str) -> DataFrame:
    """Each row once for every ``block`` of the ``count`` rows that it asks for, as ``_block`` 0, 1, ..., dealt out by ``keys``
    and block: what is emitted for one row is the work of many tasks."""
    blocks = df.withColumn("_block", F.explode(safe_range(F.ceil(count / block).cast("int"))))
    return spread(blocks, *keys, "_block")


# AUG-02 --------------------------------------------------------------------
UPSAMPLE_BLOCK = 8192


def upsample(prompts: DataFrame, quota: DataFrame, scaffold: bool = False) -> DataFrame:
    """``n // L`` whole copies of the prompt lines, then the first ``n % L`` lines.

    Row ``i`` of the output is ``lines[i % L]``; ``quota`` is ``(val_domain, quota)``. Quotas are emitted block by block.
    """
    q = quota.select(F.col("val_domain").alias("domain"), F.col("quota").cast("long").alias("quota"))
    p = prompts.join(q, "domain").withColumn("_l", prompt_lines(prompts, scaffold))
    start = F.col("_block").cast("long") * UPSAMPLE_BLOCK
    place = F.sequence(start, F.least(F.col("quota"), start + UPSAMPLE_BLOCK) - 1)
    return (emit_blocks(p, F.col("quota"), UPSAMPLE_BLOCK, "domain", "intent", "prompt_id")
            .select("domain", "intent", "intent_id", "prompt_id", "_l", F.explode(place).alias("gen_idx"))
            .select("domain", F.lit("upsample").alias("attr"), "intent", "intent_id", "prompt_id", "gen_idx",
                    F.element_at("_l", (F.col("gen_idx") % F.size("_l") + 1).cast("int"))
                    .alias("text")))


# AUG-12 --------------------------------------------------------------------
def plan_requests(df: DataFrame, quota_col: str = "quota", n_max: int = N_MAX) -> DataFrame:
    """Split each quota into requests of at most ``n_max``; zero-size requests dropped."""
    q = F.col(quota_col)
    n_req = F.ceil(q / F.lit(n_max)).cast("int")
    return (df.withColumn("req_idx", F.explode(safe_range(n_req)))
            .withColumn("n", F.least(F.lit(n_max), q - F.col("req_idx") * n_max).cast("long"))
            .where(F.col("n") > 0))


# AUG-13 --------------------------------------------------------------------
def accept_completions(completions: DataFrame, requests: DataFrame,
                       key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Trim, drop empty, keep the first ``quota`` per request by (round, choice).

    Returns ``(accepted, shortfall)``; ``shortfall`` lists requests that still
    need ``missing`` rows, i.e. the next round's request table.
    """
    c = (completions.withColumn("text", py_strip(F.col("text"))).where(F.col("text") != "")
         .join(requests.select(key, "quota"), key))
    w = Window.partitionBy(key).orderBy("round", "choice_idx")
    accepted = (c.withColumn("accept_rank", F.row_number().over(w))
                .where(F.col("accept_rank") <= F.col("quota")).drop("quota"))
    got = accepted.groupBy(key).agg(F.count(F.lit(1)).alias("got"))
    shortfall = (requests.join(got, key, "left")
                 .select(key, "quota", (F.col("quota") - F.coalesce("got", F.lit(0))).alias("missing"))
                 .where(F.col("missing") > 0))
    return accepted, shortfall


# AUG-14 --------------------------------------------------------------------
def extract_continuation(df: DataFrame, n: int | None = None, key: str = "request_id",
                         order: str = "choice_idx") -> DataFrame:
    """From ``prompt`` and ``output`` (prompt plus continuation), take line ``k``
    of the output (``k`` = prompt lines - 1), cut the ``Example {k-1}: `` prefix,
    trim, skip empty, keep the first ``n`` per request."""
    k = F.size(F.split(F.col("prompt"), "\n")) - 1
    line = F.element_at(F.split(F.col("output"), "\n"), (k + 1).cast("int"))
    cut = F.length(_line_prefix(k - 1))
    text = py_strip(F.substring(line, cut + 1, 1 << 30))
    out = df.withColumn("text", text).where(F.col("text").isNotNull() & (F.col("text") != ""))
    if n is not None:
        w = Window.partitionBy(key).orderBy(order)
        out = out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    return out


# AUG-15 --------------------------------------------------------------------
def with_attr_grid(df: DataFrame, engines: Sequence[str] = ENGINES,
                   temps: Sequence[str] = DEFAULT_TEMPS) -> DataFrame:
    """Each row once per (engine, temperature); a generator over literals, no join."""
    grid = F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(t).alias("temp"))
                     for e in engines for t in temps])
    return (df.withColumn("_g", F.explode(grid))
            .withColumn("engine", F.col("_g.engine")).withColumn("temp", F.col("_g.temp"))
            .withColumn("attr", F.concat("engine", F.lit("_"), "temp")).drop("_g"))


# AUG-17 --------------------------------------------------------------------
def resume(plan: DataFrame, done: DataFrame, keys: Sequence[str] = ("domain", "attr")) -> DataFrame:
    """Work items of ``plan`` whose keys are not yet in ``done``."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


# AUG-18 --------------------------------------------------------------------
def augment(prompts: DataFrame, quota: DataFrame, modes: Sequence[str] = ("upsample",),
            top_k: int | None = None, top_p: float | None = None,
            eda_rates: float = 0.05, scaffold: bool = False,
            generator: Generator | None = None, thesaurus: DataFrame | None = None) -> DataFrame:
    """Union of the requested modes over all domains in one job."""
    if top_k is not None and top_k < 0:
        raise ValueError("top_k must be >= 0")
    if top_p is not None and top_p > 1:
        raise ValueError("top_p must be <= 1")
    from shotweave.operators.eda import eda_domain
    parts = []
    for m in modes:
        if m == "upsample":
            parts.append(upsample(prompts, quota, scaffold))
        elif m == "eda":
            parts.append(eda_domain(prompts, quota, thesaurus, rate=eda_rates, scaffold=scaffold))
        elif generator is not None:
            parts.append(complete_quota(prompts.join(quota.withColumnRenamed("val_domain", "domain"), "domain"), "quota", generator)
                         .withColumn("attr", F.lit(m)).select(*GEN_COLS))
        else:
            raise ValueError(f"mode {m!r} needs a generator")
    out = parts[0].select(*GEN_COLS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*GEN_COLS))
    return out


# AUG-19 / UDF-01 -------------------------------------------------------------
REQUEST_COLS = ["domain", "intent", "intent_id", "prompt_id", "req_idx", "n", "prompt"]
PROMPT_KEY = ["domain", "intent", "intent_id", "prompt_id"]
REQUEST_KEY = [*PROMPT_KEY, "req_idx"]
COMPLETION_SCHEMA = "domain string, intent string, intent_id int, prompt_id int, req_idx int, choice_idx int, text string"

#: A generator: gets the request batches of a task, yields frames of texts (REQUEST_KEY and ``text``).
Generator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def each_batch(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Generator:
    """A generator that calls ``fn`` for every batch."""
    return lambda batches: map(fn, batches)


def with_model(load: Callable[[], object], fn: Callable[[object, pd.DataFrame], pd.DataFrame]) -> Generator:
    """A generator that calls ``load`` once per task, and ``fn(model, batch)`` for every batch of the task."""
    def run(batches):
        model = load()
        for batch in batches:
            yield fn(model, batch)
    return run


def complete(requests: DataFrame, generator: Generator, n_max: int = N_MAX) -> DataFrame:
    """The texts of a user generator for ``requests`` (Arrow batches), as ``GEN_COLS`` without ``attr``.

    A batch of requests is a pandas frame with ``domain, intent, intent_id, prompt_id, req_idx, n, prompt``; the generator
    yields texts in the order of their choices, with their request's key. Texts are trimmed, empty ones dropped; of a request
    the first ``n`` are taken. Requests are dealt out by their key over all tasks; the generator is called once per task.
    """
    return _answers(requests, generator).select(
        *PROMPT_KEY, (F.col("req_idx").cast("long") * n_max + F.col("choice_idx")).alias("gen_idx"), "text")


def _answers(requests: DataFrame, generator: Generator) -> DataFrame:
    """``COMPLETION_SCHEMA``: the accepted texts of each request, numbered by ``choice_idx``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted: dict[tuple, list[int]] = {}  # of each request of the task: taken, asked for

        def handed():
            for b in batches:
                for key, n in zip(b[REQUEST_KEY].itertuples(index=False, name=None), b["n"]):
                    wanted[key] = [0, int(n)]
                yield b

        for out in generator(handed()):
            rows = out[REQUEST_KEY].assign(text=[(t or "").strip(STRIPPED) for t in out["text"]])
            rows = rows[rows["text"] != ""]
            # what was taken of each request before is looked up once for all its texts in the frame
            requests = rows.groupby(REQUEST_KEY, sort=False, dropna=False)
            of, place = requests.ngroup().to_numpy(), requests.cumcount().to_numpy()
            counts = [wanted[key] for key in rows[REQUEST_KEY][place == 0].itertuples(index=False, name=None)]
            taken, asked = np.array(counts, np.int64).reshape(-1, 2).T
            choice = taken[of] + place
            for count, n in zip(counts, np.bincount(of, minlength=len(counts)).tolist(), strict=True):
                count[0] = min(count[0] + n, count[1])
            rows.insert(len(REQUEST_KEY), "choice_idx", choice)
            yield rows[choice < asked[of]]

    return spread(requests.select(*REQUEST_COLS), *PROMPT_KEY, "req_idx").mapInPandas(run, COMPLETION_SCHEMA)


# AUG-13 with AUG-19 ----------------------------------------------------------
def complete_quota(prompts: DataFrame, quota_col: str, generator: Generator, n_max: int = N_MAX, max_rounds: int = 20) -> DataFrame:
    """Exactly ``quota_col`` texts for every prompt, as ``GEN_COLS`` without ``attr``: what is missing after a round, since texts were
    empty or too few, is asked for again until nothing is.

    Each round is written down and asks for the shortfall only, in requests of at most ``n_max``. The numbers of a prompt's
    requests (``req_idx``) go on from round to round. ``gen_idx`` numbers a prompt's texts from 0 on, by request. Raises
    RuntimeError if texts are still missing after ``max_rounds``.
    """
    start = prompts.select(*PROMPT_KEY, "prompt", F.col(quota_col).cast("long").alias("missing"), F.lit(0).alias("_asked"))
    open_ = durable(start.where("missing > 0"), "prompts")
    accepted = [durable(_answers(_numbered(open_, n_max), generator), "accepted")]
    for _ in range(1, max_rounds):
        open_ = durable(_short(open_, accepted[-1], n_max), "prompts")
        if open_.isEmpty():
            break
        accepted.append(durable(_answers(_numbered(open_, n_max), generator), "accepted"))
    else:
        if left := _short(open_, accepted[-1], n_max).count():
            raise RuntimeError(f"{left} prompts miss texts after {max_rounds} rounds")
    texts = accepted[0]
    for a in accepted[1:]:
        texts = texts.unionByName(a)
    # numbers by running sums over the requests' counts, not over the texts
    before = Window.partitionBy(*PROMPT_KEY).orderBy("req_idx").rowsBetween(Window.unboundedPreceding, -1)
    starts = (texts.groupBy(*REQUEST_KEY).agg(F.count("*").alias("c"))
              .withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c"))
    return texts.join(starts, REQUEST_KEY).select(*PROMPT_KEY, (F.col("start") + F.col("choice_idx")).alias("gen_idx"), "text")


def _numbered(open_: DataFrame, n_max: int) -> DataFrame:
    """The requests of a round, numbered after those of the rounds before."""
    return plan_requests(open_, "missing", n_max).withColumn("req_idx", F.col("req_idx") + F.col("_asked"))


def _short(open_: DataFrame, answers: DataFrame, n_max: int) -> DataFrame:
    """The prompts that still miss texts after a round's answers."""
    got = answers.groupBy(*PROMPT_KEY).agg(F.count("*").alias("got"))
    left = F.col("missing") - F.coalesce("got", F.lit(0))
    asked = F.col("_asked") + F.ceil(F.col("missing") / n_max).cast("int")
    return (open_.join(got, PROMPT_KEY, "left").select(*PROMPT_KEY, "prompt", left.alias("missing"), asked.alias("_asked"))
            .where("missing > 0"))
