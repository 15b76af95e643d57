"""Relabelling with a scorer fitted in Spark (multinomial naive Bayes), votes and prompts.

The scorer stands in for the reference's fine-tuned classifier. The model is
two tables: per-class statistics (one row per class, bounded) and per
``(token, class)`` counts (distributed, joined by token). Scoring never builds
rows x classes x vocabulary: a row's score for class ``c`` is

    ln prior_c - n_tok * ln(N_c + V) + sum over its tokens seen with c of ln(count + 1)

a prediction compares the classes seen with the one that leads at the text's length. Texts are dealt into chunks of a
bounded number of tokens; a chunk gets the counts of each of its distinct tokens once, however many of its texts hold the
token, and sums them in numpy. No row for each (text, token, class) is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.functions.arrays import argmax
from shotweave.functions.text import regex_tokens
from shotweave.operators.augment import spread
from shotweave.session import MAX_CLASSES
from shotweave.sources.tables import durable

SCORE_UNIT = 1e9  # scores are sums of whole 1e-9 parts, so neither their order nor the partitions matter
CHUNK_TOKENS = 1 << 19  # tokens of a chunk of texts
LEAST_TOKENS = 1 << 15  # with fewer, more chunks don't pay for more tasks
CELLS = 1 << 22  # numbers of a dense block inside a task


@dataclass
class NaiveBayesModel:
    class_stats: DataFrame   # intent_id, intent, n_rows, n_tokens, log_prior, log_denom
    token_counts: DataFrame  # token, intent_id, cnt
    vocab_size: Column       # scalar subquery
    _arrays: tuple | None = None


# PRD-11 ----------------------------------------------------------------------
def tokenize(df: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    return df.withColumn("tokens", regex_tokens(F.col(text), limit))


# PRD-02 ----------------------------------------------------------------------
def fit_scorer(train: DataFrame, limit: int | None = None) -> NaiveBayesModel:
    """Fit on ``(text, intent_id, intent)`` rows; Laplace smoothing."""
    t = tokenize(train.select("text", "intent_id", "intent"), limit=limit)
    toks = t.select("intent_id", F.explode("tokens").alias("token"))
    token_counts = toks.groupBy("token", "intent_id").agg(F.count(F.lit(1)).alias("cnt"))
    vocab = token_counts.select(F.count_distinct("token")).scalar()
    total = t.select(F.count(F.lit(1))).scalar()
    stats = (t.groupBy("intent_id", "intent")
             .agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(F.size("tokens")).cast("long").alias("n_tokens"))
             .withColumn("log_prior", F.log(F.col("n_rows") / total))
             .withColumn("log_denom", F.log(F.col("n_tokens") + vocab)))
    return NaiveBayesModel(stats, token_counts, vocab)


def fit_scorer_table(spark, name: str, inputs: list[str], train_fn, limit: int | None = None) -> NaiveBayesModel:
    """Fit once per input version and keep the model as two tables in the shared
    checkpoint folder (class statistics, token counts by token); later jobs
    read the tables instead of refitting."""
    from shotweave.sources.tables import materialized
    fitted = {}

    def get():
        if "m" not in fitted:
            fitted["m"] = fit_scorer(train_fn(), limit)
        return fitted["m"]
    stats = materialized(spark, f"{name}-stats", inputs, lambda: get().class_stats)
    counts = materialized(spark, f"{name}-tokens", inputs, lambda: get().token_counts)
    return NaiveBayesModel(stats, counts, counts.select(F.count_distinct("token")).scalar())


def _class_arrays(model: NaiveBayesModel):
    """Per-class vectors as literals: bounded by the number of classes (checked).

    Collected once per fitted model and reused by every scoring call."""
    if model._arrays is not None:
        return model._arrays
    rows = (model.class_stats.select("intent_id", "intent", "log_prior", "log_denom")
            .orderBy("intent_id").limit(MAX_CLASSES + 1).collect())
    if len(rows) > MAX_CLASSES:
        raise ValueError("too many classes for a dense score vector")
    ids = F.array(*[F.lit(r[0]) for r in rows])
    names = F.array(*[F.lit(r[1]) for r in rows])
    lp = F.array(*[F.lit(_fixed(r[2])) for r in rows])
    ld = F.array(*[F.lit(_fixed(r[3])) for r in rows])
    model._arrays = (ids, names, lp, ld)
    return model._arrays


def _fixed(x: float) -> int:
    """Whole 1e-9 parts, halves away from zero as in SQL's round."""
    return int(math.copysign(math.floor(abs(x) * SCORE_UNIT + 0.5), x))


def _parts(x: Column) -> Column:
    """:func:`_fixed` of a column."""
    return F.round(x * SCORE_UNIT).cast("long")


# Sums over a chunk of texts -----------------------------------------------------
def _owners(texts: pa.Table, by: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    """The texts in an order in which those alike in ``by`` stand together, and the number of each one's owner, rising."""
    codes = np.stack([pc.dictionary_encode(texts[c].combine_chunks()).indices.to_numpy() for c in by])
    _, owner = np.unique(codes, axis=1, return_inverse=True)
    owner = owner.reshape(-1)
    order = np.argsort(owner, kind="stable")
    return texts.take(pa.array(order)), owner[order]


def _token_sums(owner: np.ndarray, tokens: pa.ChunkedArray, counts: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first owner, class ids, sums owner x class)``, block by block: what the ``tokens`` of each owner weigh in each class.

    Blocks of classes come by rising id, within them blocks of owners. Dense blocks hold at most about ``CELLS`` numbers."""
    place = pc.fill_null(pc.index_in(tokens, value_set=counts["token"].combine_chunks()), -1).to_numpy()
    owner, place = owner[place >= 0], place[place >= 0]
    if not len(owner):
        return
    word = np.repeat(np.arange(len(counts)), pc.list_value_length(counts["ids"]).to_numpy())
    ids, weights = (pc.list_flatten(counts[c]).to_numpy() for c in ("ids", "weights"))
    order = np.argsort(ids, kind="stable")
    ids, weights, word = ids[order], weights[order], word[order]
    classes = np.unique(ids)
    width = min(len(classes), max(1, CELLS // len(counts)))
    step = max(1, CELLS // width)
    for c in range(0, len(classes), width):
        some = classes[c:c + width]
        x, y = np.searchsorted(ids, some[0]), np.searchsorted(ids, some[-1], "right")
        table = np.zeros((len(counts), len(some)), np.int64)
        np.add.at(table, (word[x:y], np.searchsorted(some, ids[x:y])), weights[x:y])
        for first in range(0, int(owner[-1]) + 1, step):
            sums = np.zeros((min(step, int(owner[-1]) + 1 - first), len(some)), np.int64)
            x, y = np.searchsorted(owner, [first, first + step])
            for at in range(x, y, step):
                own = owner[at:min(at + step, y)] - first
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                sums[own[starts]] += np.add.reduceat(table[place[at:at + len(own)]], starts, axis=0)
            yield first, some, sums


def _all_sums(key: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``key, ids, sums`` of a chunk: the classes seen in each key's texts."""
    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        texts, owner = _owners(texts, [key])
        at = np.repeat(owner, pc.list_value_length(texts["tokens"]).to_numpy())
        who, ids, sums = ([np.zeros(0, np.int64)] for _ in range(3))
        for first, classes, block in _token_sums(at, pc.list_flatten(texts["tokens"]), counts.filter(counts["token"].is_valid())):
            row, col = np.nonzero(block)
            who.append(row + first)
            ids.append(classes[col])
            sums.append(block[row, col])
        who, ids, sums = (np.concatenate(x) for x in (who, ids, sums))
        order = np.argsort(who, kind="stable")
        each, size = np.unique(who, return_counts=True)
        begin = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
        lists = [pa.ListArray.from_arrays(begin, pa.array(x[order], pa.int64())) for x in (ids, sums)]
        keys = texts[key].take(pa.array(np.searchsorted(owner, each)))
        return pa.table([keys, *lists], [key, "ids", "sums"])
    return run


def _best_sums(key: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``key, score, id`` of a chunk: the best of the classes seen in a key's texts of one length, the smallest id of equal ones."""
    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        lines = counts.filter(counts["token"].is_null())
        line_id = pc.list_flatten(lines["ids"]).to_numpy()
        lp, ld = pc.list_flatten(lines["weights"]).to_numpy().reshape(-1, 2).T
        order = np.argsort(line_id, kind="stable")
        line_id, lp, ld = line_id[order], lp[order], ld[order]
        texts, owner = _owners(texts, [key, "n_tok"])
        at = np.repeat(owner, pc.list_value_length(texts["tokens"]).to_numpy())
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        n_tok = texts["n_tok"].to_numpy()[head]
        least = np.iinfo(np.int64).min
        best, best_id = np.full(len(head), least), np.zeros(len(head), np.int64)
        for first, classes, block in _token_sums(at, pc.list_flatten(texts["tokens"]), counts.filter(counts["token"].is_valid())):
            x, y = np.searchsorted(line_id, classes[0]), np.searchsorted(line_id, classes[-1], "right")
            some = np.arange(x, y)[np.isin(line_id[x:y], classes)]
            if not len(some):
                continue
            seen = block[:, np.searchsorted(classes, line_id[some])]
            here = slice(first, first + len(block))
            score = np.where(seen > 0, lp[some] - n_tok[here, None] * ld[some] + seen, least)
            top = score.argmax(1)
            score = score[np.arange(len(block)), top]
            ahead = score > best[here]
            best[here] = np.where(ahead, score, best[here])
            best_id[here] = np.where(ahead, line_id[some][top], best_id[here])
        found = np.flatnonzero(best > least)
        keys = texts[key].take(pa.array(head[found]))
        return pa.table([keys, pa.array(best[found]), pa.array(best_id[found])], [key, "score", "id"])
    return run


def _chunked(rows: DataFrame, key: str, model: NaiveBayesModel, stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The texts of ``rows (key, n_tok, tokens)``, a written table, by ``_chunk``, and for each chunk the counts of its distinct
    tokens: ``_of, token, ids, weights``; with ``stats``, also a row without token for every class, with ``lp`` and ``ld``.

    Texts of a key share a chunk. The number of chunks follows the number of tokens."""
    total = rows.agg(F.sum("n_tok")).first()[0] or 0
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-total // CHUNK_TOKENS), min(tasks, total // LEAST_TOKENS))
    texts = spread(rows.where(F.col(key).isNotNull() & (F.col("n_tok") > 0))
                   .withColumn("_chunk", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), "_chunk")
    entry = F.struct(F.col("intent_id").cast("long").alias("id"), _parts(F.log(F.col("cnt") + 1.0)).alias("w"))
    packed = model.token_counts.groupBy("token").agg(F.collect_list(entry).alias("_e"))
    counts = (texts.select("_chunk", F.explode("tokens").alias("token")).distinct().join(packed, "token")
              .select(F.col("_chunk").alias("_of"), "token", F.col("_e.id").alias("ids"), F.col("_e.w").alias("weights")))
    if stats is not None:
        chunk = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_of")
        counts = counts.unionByName(stats.select(chunk, F.lit(None).cast("string").alias("token"),
                                                 F.array(F.col("intent_id").cast("long")).alias("ids"), F.array("lp", "ld").alias("weights")))
    return texts, spread(counts, "_of")


def _by_chunk(chunks: tuple[DataFrame, DataFrame], key: str, make: Callable, columns: dict[str, T.DataType]) -> DataFrame:
    """``make`` of every chunk's texts and counts, as ``key`` and ``columns``."""
    texts, counts = chunks
    fields = [T.StructField(key, texts.schema[key].dataType), *(T.StructField(c, t) for c, t in columns.items())]
    return texts.groupBy("_chunk").cogroup(counts.groupBy("_of")).applyInArrow(make(key), T.StructType(fields))


# PRD-03 ----------------------------------------------------------------------
def score_rows(df: DataFrame, model: NaiveBayesModel, key: str = "row_key",
               limit: int | None = None) -> DataFrame:
    """Adds ``scores ARRAY<DOUBLE>`` (one per trained class, in id order)."""
    ids, names, lp, ld = _class_arrays(model)
    rows = tokenize(df, limit=limit).withColumn("n_tok", F.size("tokens"))
    seen = _by_chunk(_chunked(durable(rows.select(key, "n_tok", "tokens"), "tokens"), key, model), key, _all_sums,
                     {"ids": T.ArrayType(T.LongType()), "sums": T.ArrayType(T.LongType())})
    seen_map = seen.select(key, F.map_from_arrays(F.col("ids").cast("array<int>"), "sums").alias("_seen"))
    scored = rows.join(seen_map, key, "left")
    scores = F.transform(
        ids, lambda c, i: (lp[i] - F.col("n_tok") * ld[i]
                           + F.coalesce(F.col("_seen")[c], F.lit(0).cast("long"))) / F.lit(SCORE_UNIT))
    return (scored.withColumn("scores", scores)
            .withColumn("_ids", ids).withColumn("_names", names).drop("_seen", "tokens"))


# PRD-04 ----------------------------------------------------------------------
def _fixed_stats(model: NaiveBayesModel) -> DataFrame:
    """``intent_id, intent, lp, ld``: log prior and log denominator in whole 1e-9 parts."""
    return model.class_stats.select("intent_id", "intent", _parts(F.col("log_prior")).alias("lp"), _parts(F.col("log_denom")).alias("ld"))


def envelope(lines: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The upper envelope over whole n >= 0 of the lines lp - n * ld, given as (id, lp, ld): ``(first n, id, lp, ld)`` by rising n;
    of lines that meet at an n, the smallest id has it."""
    out: list[tuple[int, int, int, int]] = []
    best: dict[int, tuple[int, int]] = {}
    for i, lp, ld in lines:  # of parallel lines the highest
        if ld not in best or (-lp, i) < (-best[ld][0], best[ld][1]):
            best[ld] = (lp, i)
    for ld in sorted(best, reverse=True):  # flatter lines win further on
        lp, i = best[ld]
        start = 0
        while out:
            n0, j, lp0, ld0 = out[-1]
            gap, slope = lp0 - lp, ld0 - ld  # ahead from n * slope > gap on; at equality the smaller id
            start = max(0, -(-gap // slope) if gap % slope == 0 and i < j else gap // slope + 1)
            if start > n0:
                break
            out.pop()
        else:
            start = 0
        out.append((start, i, lp, ld))
    return out


def _best_unseen(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``n_tok, line``: for every text length, the class ahead by prior and length alone, as ``struct(score, -id)``.

    A class that another one beats by prior and by length never leads; those that none beats, few of them, go to the driver."""
    before = Window.orderBy("ld", F.desc("lp"), "intent_id").rowsBetween(Window.unboundedPreceding, -1)
    front = stats.withColumn("_top", F.max("lp").over(before)).where(F.col("_top").isNull() | (F.col("lp") > F.col("_top")))
    lines = [(r.intent_id, r.lp, r.ld) for r in front.select("intent_id", "lp", "ld").limit(MAX_CLASSES + 1).collect()]
    steps = envelope(lines)
    if len(lines) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes that no other beats")
    n = F.col("n_tok")
    place = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(st, ("begin", "id", "lp", "ld"))]) for st in steps])
    lead = F.element_at(F.filter(place, lambda x: x["begin"] <= n), -1)
    return (rows.select("n_tok").distinct().select("n_tok", lead.alias("_l"))
            .select("n_tok", F.struct((F.col("_l.lp") - n * F.col("_l.ld")).alias("score"), (-F.col("_l.id")).alias("id")).alias("line")))


def predict_keys(df: DataFrame, model: NaiveBayesModel, key: str = "row_key", limit: int | None = None) -> DataFrame:
    """``key, pred_id, pred``: the first class of the highest score, of any number of classes.

    A class whose tokens a text has scores above its line lp - n * ld, so the best of all classes is the best of those seen
    and of the one line that leads at the text's length: no row is scored for every class."""
    stats = _fixed_stats(model)
    tokens = tokenize(df.select(key, "text"), limit=limit).select(key, F.size("tokens").cast("long").alias("n_tok"), "tokens")
    rows = durable(tokens, "tokens")
    seen = _by_chunk(_chunked(rows, key, model, stats), key, _best_sums, {"score": T.LongType(), "id": T.LongType()})
    best = seen.groupBy(key).agg(F.max(F.struct("score", (-F.col("id")).alias("id"))).alias("best"))
    lead = rows.select(key, "n_tok").join(_best_unseen(rows, stats), "n_tok")
    top = lead.join(best, key, "left").select(key, F.greatest("line", "best").alias("top"))
    return (top.select(key, (-F.col("top.id")).cast("int").alias("pred_id"))
            .join(stats.select(F.col("intent_id").alias("pred_id"), F.col("intent").alias("pred")), "pred_id")
            .select(key, "pred_id", "pred"))


def predict(df: DataFrame, model: NaiveBayesModel, key: str = "row_key", limit: int | None = None) -> DataFrame:
    """Adds ``pred_id`` and ``pred`` (first maximum, numpy argmax semantics)."""
    return df.join(predict_keys(df, model, key, limit), key)


# PRD-01 ----------------------------------------------------------------------
def pool_generated(generated: DataFrame, corpus: DataFrame, attrs=None,
                   oos_domain: str = "oos") -> DataFrame:
    """Generated rows per attr over all non-OOS domains, plus the base val and test rows.

    Output: ``attr, row_key, text, old_intent_id``.
    """
    g = generated.where(F.col("domain") != F.lit(oos_domain))
    if attrs is not None:
        g = g.where(F.col("attr").isin(list(attrs)))
    g = g.select("attr",
                 F.concat_ws(":", "attr", "domain", "intent",
                             F.col("prompt_id").cast("string"),
                             F.col("gen_idx").cast("string")).alias("row_key"),
                 "text", F.col("intent_id").alias("old_intent_id"),
                 F.col("intent").alias("old_intent"))
    base = (corpus.where(F.col("split").isin("val", "test"))
            .select(F.col("split").alias("attr"),
                    F.concat_ws(":", "split", F.col("row_id").cast("string")).alias("row_key"),
                    "text", F.col("intent_id").alias("old_intent_id"),
                    F.col("intent").alias("old_intent")))
    return g.unionByName(base)


# PRD-05 ----------------------------------------------------------------------
def relabel(pool: DataFrame, model: NaiveBayesModel, done: DataFrame | None = None,
            dedupe: bool = True) -> DataFrame:
    """``attr, row_key, text, old_intent_id, old_intent, intent_id, intent`` for
    every pooled row; attrs already in ``done`` are skipped (resume).

    Generated pools repeat texts (upsampling copies seeds; generators repeat
    themselves), so by default each distinct text is scored once and the
    prediction is joined back to every row carrying it."""
    if done is not None:
        pool = pool.join(done.select("attr").distinct(), "attr", "left_anti")
    cols = ["attr", "row_key", "text", "old_intent_id", "old_intent"]
    if dedupe:
        # a digest stands for the text in the joins: no token row or prediction carries it
        keyed = pool.withColumn("_digest", F.sha2("text", 256))
        p = keyed.join(predict_keys(keyed.select("_digest", "text").dropDuplicates(["_digest"]), model, key="_digest"), "_digest")
    else:
        p = predict(pool, model, key="row_key")
    return p.select(*cols, F.col("pred_id").alias("intent_id"), F.col("pred").alias("intent"))


# PRD-06 ----------------------------------------------------------------------
def restricted_argmax(logits: Column, candidate_ids: list[int]) -> Column:
    """Argmax restricted to sorted candidate ids, mapped back to the class id."""
    cand = sorted(candidate_ids)
    sub = F.array(*[F.element_at(logits, c + 1) for c in cand])
    return F.element_at(F.array(*[F.lit(c) for c in cand]), argmax(sub) + 1)


# PRD-07 ----------------------------------------------------------------------
def majority_vote(responses: DataFrame, candidates: DataFrame, key: str = "row_id") -> DataFrame:
    """Candidate with the most exact (trimmed) matches; ties and all-zero -> earliest candidate.

    ``responses``: ``key, response``; ``candidates``: ``key, candidate, pos``.
    """
    counts = (responses.select(key, F.trim("response").alias("candidate"))
              .groupBy(key, "candidate").agg(F.count(F.lit(1)).alias("n")))
    c = candidates.join(counts, [key, "candidate"], "left")
    return c.groupBy(key).agg(
        F.max_by("candidate", F.struct(F.coalesce("n", F.lit(0)), -F.col("pos"))).alias("vote"))


# PRD-08 ----------------------------------------------------------------------
def vote_filter(rows: DataFrame, votes: DataFrame, key: str = "row_id"):
    """Rows whose vote equals the old intent; plus ``(kept, total, pct)``."""
    j = rows.join(votes, key, "left")
    kept = j.where(F.col("vote") == F.col("old_intent"))
    report = j.agg(F.count_if(F.col("vote") == F.col("old_intent")).alias("kept"),
                   F.count(F.lit(1)).alias("total"))
    report = report.withColumn("pct", F.round(100.0 * F.col("kept") / F.col("total"), 2))
    return kept, report


# PRD-10 ----------------------------------------------------------------------
# Prompt wording.
CATEGORY_HEADER = ("Each example in the following list contains a sentence that belongs to a "
                   "category. A category is one of the following: ")


def classification_prompt(seeds: DataFrame, categories: list[str]) -> Column:
    """Header with categories plus seed lines; a prompt holds at most MAX_CLASSES seeds, more raise."""
    header = CATEGORY_HEADER + ", ".join(categories)
    rows = seeds.select("intent", "text").orderBy("intent", "text").limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} seeds for one prompt")
    body = "\n".join(f"sentence: {t} ; category: {i}" for i, t in rows)
    return F.lit(header + "\n\n" + body + "\n")


def classification_query(prefix: Column, text: Column) -> Column:
    return F.concat(prefix, F.lit("sentence: "), text, F.lit(" ; category:"))
