"""Materialised intermediate tables in the shared checkpoint folder.

A derived base table (the utterance corpus) is written once per input
version and read back by every later job: lineage is cut at a durable table
on shared storage (it survives lost executors), and downstream filters on the
partition column prune whole directories. The version key is the length and
modification time of every input file, read through the Hadoop file system
API so it works on any storage the cluster uses.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.session import checkpoint_dir


def file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def input_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    h = hashlib.sha1()
    for path in paths:
        fs, p = file_system(spark, path)
        it = fs.listFiles(p, True)
        entries = []
        while it.hasNext():
            st = it.next()
            entries.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()}")
        for e in sorted(entries):
            h.update(e.encode())
    return h.hexdigest()[:16]


_CODE_KEY: list[str] = []


def code_fingerprint() -> str:
    """Hash of the library's source: a code change never reads a table built by older code."""
    if not _CODE_KEY:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        h = hashlib.sha1()
        for dirpath, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    with open(os.path.join(dirpath, f), "rb") as fh:
                        h.update(f.encode() + b"\0" + fh.read())
        _CODE_KEY.append(h.hexdigest()[:12])
    return _CODE_KEY[0]


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, os.path.join(path, "_SUCCESS"))
    return fs.exists(p)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile leave no shuffle files: Spark removes them as soon as a table is written. Else they stay on the
    executors' disks until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def materialized(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame],
                 partition_by: str | None = None) -> DataFrame:
    """Read ``name`` for this input version from the checkpoint folder, building it once."""
    key = input_fingerprint(spark, inputs)
    path = os.path.join(checkpoint_dir(spark), "shotweave", f"{name}-{key}-{code_fingerprint()}")
    if not exists(spark, path):
        tmp = f"{path}.tmp-{uuid.uuid4().hex}"
        w = build().write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            w = w.partitionBy(partition_by)
        with shuffles_removed(spark):
            w.parquet(tmp)
        fs, src = file_system(spark, tmp)
        _, dst = file_system(spark, path)
        if not fs.rename(src, dst) and not exists(spark, path):
            raise RuntimeError(f"could not publish {path}")
    return spark.read.parquet(path)


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the checkpoint folder and read back: its lineage ends at a table that survives lost executors."""
    path = os.path.join(checkpoint_dir(df.sparkSession), "shotweave", f"{name}-{uuid.uuid4().hex}")
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``durable`` wrote. No frame that is still to run may read it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, p = file_system(spark, folder)
        fs.delete(p, True)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A short text as one file, through the Hadoop file system API."""
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def task_folder(spark: SparkSession, path: str) -> str | None:
    """The full URI of ``path``, made as a folder, if tasks can write files below it by pyarrow: a folder that all machines share,
    or a store that pyarrow knows. Else None."""
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    uri = re.sub("^file:/+", "file:///", fs.makeQualified(p).toUri().toString())
    try:
        arrow_fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return None
    return uri


def write_files(folder: str, files: Iterable[tuple[str, str]]) -> None:
    """``(name, text)`` pairs as short files below a ``task_folder``, from inside a task; one that runs again replaces its files."""
    store, base = arrow_fs.FileSystem.from_uri(folder)
    for name, text in files:
        path = f"{base.rstrip('/')}/{name}"
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(text.encode())


def read_small(spark: SparkSession, path: str) -> str:
    """What ``write_small`` wrote."""
    fs, p = file_system(spark, path)
    source = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


ROW_BITS = 33  # monotonically_increasing_id: partition above, row within it below


def numbered(df: DataFrame, col: str, start: int = 0) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` on in its order (that of an ``orderBy``, or of its partitions).

    The rows are written with partition and place; numbers are places plus the counts of the partitions before, a table of
    one row per partition. All of it are built-in expressions."""
    rows = durable(df.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (rows.groupBy(part.alias("_part")).agg(F.count("*").alias("c"))
              .select("_part", (F.coalesce(F.sum("c").over(before), F.lit(0)) + start).alias("_before")))
    place = F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)
    return (rows.withColumn("_part", part).join(F.broadcast(counts), "_part")  # a row per task that wrote the table
            .withColumn(col, F.col("_before") + place).drop("_part", "_before", "_place"))
