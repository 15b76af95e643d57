"""Human-review tables: review sheets, sheet statistics, shown generators,
blind sheets and annotator scoring. Rendering (fonts, widths) is not built;
sheets are written as CSV partitions by the sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.functions.rand import draw
from shotweave.operators.labels import sheet_key
from shotweave.sources.tables import durable, numbered


class AnnotationMismatch(ValueError):
    """Answers and labels do not pair up line by line."""


# REP-01 ------------------------------------------------------------------------
def review_rows(f_train: DataFrame, relabelled: DataFrame) -> DataFrame:
    """Per attr and sheet ``domain<>intent``: seed prompts, then generated text with
    the scorer's prediction, for generated rows whose intent has a sheet.

    The generator list is bounded metadata; prompts are repeated per generator
    with a generator over the literal list, not a join. ``relabelled`` is written
    down, so that its predictions are joined once for the list and the rows."""
    from shotweave.operators.sample import bounded_values
    relabelled = durable(relabelled.select("attr", "old_intent", "text", "intent", "row_key"), "relabelled")
    attrs = bounded_values(relabelled, "attr")
    sheets = f_train.select("domain", "intent").distinct()
    name = F.concat_ws("<>", "domain", sheet_key(F.col("intent")))
    prompts = (f_train.select("domain", "intent", "text", F.col("row_id").cast("string").alias("row_key"))
               .withColumn("attr", F.explode(F.array(*[F.lit(a) for a in attrs]))))
    gen = (relabelled.select("attr", F.col("old_intent").alias("intent"), "text",
                             sheet_key(F.col("intent")).alias("oracle_prediction"), "row_key")
           .join(sheets, "intent"))
    return (prompts.select("attr", name.alias("sheet"), F.lit("prompt").alias("kind"), "text",
                           F.lit(None).cast("string").alias("oracle_prediction"), "row_key")
            .unionByName(gen.select("attr", name.alias("sheet"), F.lit("generated").alias("kind"), "text",
                                    "oracle_prediction", "row_key")))


# REP-02 ------------------------------------------------------------------------
def sheet_stats(rows: DataFrame) -> DataFrame:
    """Faithful count, ``x/y``, percent (null with nothing generated) and longest lengths;
    order by percent ascending for display."""
    intent = F.element_at(F.split("sheet", "<>"), 2)
    g = F.col("kind") == "generated"
    s = rows.groupBy("attr", "sheet").agg(
        F.count_if(g & (F.col("oracle_prediction") == intent)).alias("faithful"),
        F.count_if(g).alias("generated"),
        F.max(F.length("text")).alias("max_text_len"),
        F.max(F.length("oracle_prediction")).alias("max_pred_len"))
    return (s.withColumn("ratio", F.concat_ws("/", F.col("faithful").cast("string"), F.col("generated").cast("string")))
            .withColumn("pct", F.when(F.col("generated") > 0,
                                      F.round(100.0 * F.col("faithful") / F.col("generated"), 2))))


# REP-03 ------------------------------------------------------------------------
def shown_generators(df: DataFrame, attr: str = "attr") -> DataFrame:
    a = F.col(attr)
    return df.where(~a.contains("_") | (F.element_at(F.split(a, "_"), 2) == "1.0"))


# REP-04 ------------------------------------------------------------------------
def blind_sheet(rows: DataFrame, intents: Sequence[str] | DataFrame, seed: str = "blind") -> DataFrame:
    """Rows of the chosen intents in keyed-shuffle order: ``line_no, text, label``.

    ``line_no`` is the 1-based position in the shuffle, numbered over a range-
    partitioned sort (no single-task window); the sheet
    shows ``text`` and the answer key keeps ``label``."""
    from shotweave.operators.labels import keep_intents
    r = (keep_intents(rows, intents).withColumn("_k", draw(seed, F.col("row_id")))
         .orderBy("_k", "row_id").select("text", F.col("intent").alias("label")))
    return numbered(r, "line_no", start=1).select("line_no", "text", "label")


# REP-05 / SRC-09 ---------------------------------------------------------------
def pair_lines(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Full outer join on line number; an unpaired line raises (length check)."""
    j = answers.join(labels, "line_no", "full_outer")
    bad = j.where(F.col("code").isNull() | F.col("label").isNull()).limit(1).collect()
    if bad:
        raise AnnotationMismatch(f"answers and labels differ at line {bad[0]['line_no']}")
    return j


def score_annotator(answers: DataFrame, labels: DataFrame, code_map: dict[str, str]) -> DataFrame:
    """Code -> label name, then agreement overall (label null) and per class (rollup)."""
    j = pair_lines(answers, labels)
    m = F.create_map(*[x for k, v in code_map.items() for x in (F.lit(k), F.lit(v))])
    j = j.withColumn("pred", m[F.col("code")])
    return (j.rollup("label").agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6)
                                  .alias("accuracy"), F.count(F.lit(1)).alias("n_rows")))
