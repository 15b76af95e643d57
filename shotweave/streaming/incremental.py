"""STR-01: incremental relabel / augment.

New batches of generated rows arrive as Parquet files. The keys of all rows seen so far are state of the stream (a
deduplicating operator whose state store lives in the stream's checkpoint), so what was processed is never read from the
sink again, and a batch costs by its own size. Each micro-batch writes a folder of its own, named by its number: a batch
that is replayed after a lost executor, or after a restart between the write and the checkpoint's commit, overwrites its
own folder and adds nothing.

A sink belongs to the checkpoint whose batches it holds; another checkpoint for it is refused, since its batch numbers
and its state would start anew.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shotweave.session import checkpoint_dir
from shotweave.sources.tables import exists, file_system, read_small, write_small

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OWNER = "_checkpoint_of_batches"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def read_sink(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches that a sink holds; none where nothing was written yet."""
    fs, p = file_system(spark, f"{sink}/batch=*")
    found = fs.globStatus(p)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{sink}/batch=*")


def _claim(spark: SparkSession, sink: str, checkpoint: str) -> None:
    mark = f"{sink}/{OWNER}"
    fs, p = file_system(spark, mark)
    if fs.exists(p):
        if (owner := read_small(spark, mark)) != checkpoint:
            raise ValueError(f"{sink} holds the batches of {owner}")
    else:
        write_small(spark, mark, checkpoint)


def write_batch(df: DataFrame, batch: int, sink: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """``transform`` of one micro-batch into its own folder of the sink. The batch is written down first: its rows come from
    an operator with state, which must run once, however often ``transform`` reads them."""
    spark = df.sparkSession
    arrived = f"{sink}/_arrived-{batch}"
    df.write.mode("overwrite").parquet(arrived)
    transform(spark.read.schema(df.schema).parquet(arrived)).write.mode("overwrite").parquet(f"{sink}/batch={batch}")
    fs, p = file_system(spark, arrived)
    fs.delete(p, True)


def incremental(spark: SparkSession, source: str, source_schema: T.StructType, sink: str,
                transform: Callable[[DataFrame], DataFrame], key: str | list[str] = "row_key",
                checkpoint: str | None = None, event_time: str | None = None, late: str = "7 days") -> int:
    """Process every file under ``source`` not yet processed; returns batches run. ``read_sink`` gives the rows.

    A row whose ``key`` has come before is left out. With ``event_time`` keys are forgotten once the stream's time is
    ``late`` past them; without it all are kept. The keys' state is in RocksDB unless the session names another store.
    """
    checkpoint = checkpoint or f"{sink}-checkpoint"
    _claim(spark, sink, checkpoint)
    keys = [key] if isinstance(key, str) else list(key)
    stream = spark.readStream.schema(source_schema).parquet(source)
    if event_time:
        new = stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)
    else:
        new = stream.dropDuplicates(keys)
    seen = {"n": 0}

    def run_batch(df: DataFrame, batch: int) -> None:
        write_batch(df, batch, sink, transform)
        seen["n"] += 1

    given = spark.conf.get(PROVIDER, None)
    if given is None or given.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = (new.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    finally:
        if given is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, given)
    q.awaitTermination()
    return seen["n"]


def committed(spark: SparkSession, sink: str, batch: int) -> bool:
    """Whether a batch's folder is complete."""
    return exists(spark, f"{sink}/batch={batch}")
