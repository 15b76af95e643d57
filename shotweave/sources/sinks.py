"""Writers: partitioned tables, metric JSON, review sheets and the plot frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.sources.tables import file_system


# SNK-01 ------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, partition_by: str | list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Parquet, partitioned by ``attr`` or ``split``; overwrite replaces only the
    partitions present in ``df`` (dynamic partition overwrite), so one generator
    can be rewritten without touching the others."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


# SNK-02 ------------------------------------------------------------------------
def write_metrics_json(metrics: DataFrame, path: str, key: str = "config_id", mode: str = "overwrite") -> None:
    """One JSON line per config: ``{config_id: {metric: value, ...}}``."""
    vals = [c for c in metrics.columns if c != key]
    out = metrics.select(F.to_json(F.create_map(F.col(key), F.struct(*vals))).alias("value"))
    out.write.mode(mode).text(path)


# SNK-03 ------------------------------------------------------------------------
SHEET_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_sheets(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Review sheets as CSV, one folder per (attr, sheet). Cells keep their quotes, blanks and line breaks; null is empty."""
    (rows.withColumn("sheet", F.regexp_replace("sheet", "[/<>]", "_"))
     .write.mode(mode).partitionBy("attr", "sheet").options(**SHEET_CSV).option("quoteAll", True).csv(path))


def read_sheets(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Sheets as written: ``columns`` (a schema of strings) and ``attr, sheet``; empty cells are empty strings."""
    rows = spark.read.schema(f"{columns}, attr string, sheet string").options(**SHEET_CSV).option("multiLine", True).csv(path)
    return rows.fillna("", [c for c, _ in rows.dtypes])


# SNK-04 ------------------------------------------------------------------------
def write_or_reuse(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write once (``errorifexists``); if the table already exists, read it back."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
