"""Line dedup by distinct-site spread.

A line that many different sites carry is boilerplate. For every line hash a HyperLogLog
sketch of its sites is built by partial aggregation (sketches merge, so a hot line is
reduced before the shuffle). Lines whose estimate is clear of the threshold are decided by
it; lines near it get an exact count of distinct sites. Then every line on ``min_sites``
sites or more is taken out of all documents, and the lines that are left are joined again.

Lines are cut at ``\\n`` and compared after trimming blanks; blank lines never count.
Defined results: null text stays null, an empty text stays empty; a null site counts for no
spread, its lines are still cleaned; a document whose lines all go keeps an empty text; rows
that repeat a doc_id are cleaned each on its own; a null doc_id too; further columns pass
through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave.llm.common import BROADCAST_ROWS, durable, free_name

#: Registers of the sketches as a power of two (standard error about 1.6 %); estimates within this share
#: of the threshold, more than six standard errors, are counted exactly.
LG_K, MARGIN = 12, 0.15


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r"))


def line_hash(c: Column) -> Column:
    """128 bits of a line, as two longs."""
    return F.struct(F.xxhash64(c).alias("x"), F.xxhash64(c, F.lit(1)).alias("y"))


def site_lines(docs: DataFrame, site: str, text: str) -> DataFrame:
    lines = docs.select(F.col(site).cast("string").alias("site"), F.explode(F.split(F.col(text), "\n")).alias("line"))
    lines = lines.select("site", trimmed(F.col("line")).alias("line")).where("line != '' and site is not null")
    return lines.select("site", line_hash(F.col("line")).alias("h"))


def wide_lines(docs: DataFrame, min_sites: int, site: str = "source", text: str = "text") -> DataFrame:
    """The hashes ``h`` of lines on ``min_sites`` distinct sites or more."""
    lines = site_lines(docs, site, text)
    spread = durable(lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"))
                     .select("h", F.hll_sketch_estimate("s").alias("estimate"))
                     .where(F.col("estimate") >= min_sites * (1 - MARGIN)), "spread")
    unsure = spread.where(F.col("estimate") < min_sites * (1 + MARGIN)).select("h")
    exact = (lines.join(F.broadcast(unsure) if unsure.count() <= BROADCAST_ROWS else unsure, "h", "left_semi")
             .distinct().groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= min_sites).select("h"))
    return durable(spread.where(F.col("estimate") >= min_sites * (1 + MARGIN)).select("h").union(exact), "wide")


def remove_site_lines(docs: DataFrame, min_sites: int = 10, site: str = "source", text: str = "text",
                      counts: bool = False) -> DataFrame:
    """``docs`` with lines on ``min_sites`` sites or more removed from ``text``; with ``counts`` also the columns
    ``n_lines long, removed array<long>`` (0-based places of removed lines), in place of input columns of these names."""
    row, gone = free_name(docs, "__row"), free_name(docs, "__gone")
    wide = _checked(wide_lines(docs, min_sites, site, text))
    # a row's key is its content: equal texts lose the same lines, and the same places merge before the shuffle
    content = F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.col(text), F.lit(1)).alias("y"))
    # the key before the lines: beside a generator it would be computed for every line, over the whole text
    lines = docs.select(content.alias("k"), F.split(F.col(text), "\n").alias("ls")).select("k", F.posexplode("ls").alias("i", "line"))
    hit = lines.select("k", "i", line_hash(trimmed(F.col("line"))).alias("h")).join(wide, "h", "left_semi")
    places = durable(hit.groupBy(F.col("k").alias(row)).agg(F.sort_array(F.collect_set(F.col("i").cast("long"))).alias(gone)), "places")
    out = docs.withColumn(row, content).join(_checked(places), row, "left")
    # the places that stay are a difference of sets, so a text of many lines takes time in proportion
    stay = lambda ls: F.array_except(F.sequence(F.lit(0).cast("long"), F.size(ls).cast("long") - 1), F.col(gone))
    kept = F.get(F.transform(F.array(F.split(F.col(text), "\n")), lambda ls: F.array_join(
        F.transform(stay(ls), lambda i: F.get(ls, i.cast("int"))), "\n")), F.lit(0))
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)
    columns = {c: F.col(c) for c in docs.columns} | {text: new.alias(text)}
    if counts:
        n = F.when(F.length(text) > 0, F.size(F.split(F.col(text), "\n"))).otherwise(0)
        columns |= {"n_lines": n.cast("long").alias("n_lines"),
                    "removed": F.coalesce(gone, F.array().cast("array<long>")).alias("removed")}
    return out.select(*columns.values())


def _checked(small: DataFrame) -> DataFrame:
    """A durable table, broadcast where its counted rows are few enough, else joined by a shuffle."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small
