"""A table replayed as a stream, for back-fills and for tests of stream operators against their batch forms."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed(slices: Iterable[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that transform(stream) gives out when the slices arrive one after the other, each as one batch.

    Each slice is written to the shared folder and taken in by a run of the query that resumes from its checkpoint, so a lost
    driver costs a slice at most.  State is held in RocksDB, not in the executors' heaps.  All slices have one schema.
    """
    found = None
    for k, rows in enumerate(slices):
        spark = rows.sparkSession
        if found is None:
            found = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
            spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{found}/in").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{found}/in"))
            schema, before = rows.schema, spark.conf.get(PROVIDER)
        rows.write.parquet(f"{found}/in/slice={k}")
        spark.conf.set(PROVIDER, ROCKS)
        try:
            made = transform(spark.readStream.schema(schema).parquet(f"{found}/in/slice=*"))
            made.writeStream.format("parquet").option("checkpointLocation", f"{found}/checkpoint").trigger(availableNow=True).start(f"{found}/out").awaitTermination()
        finally:
            spark.conf.set(PROVIDER, before)
    if found is None:
        raise ValueError("a replay needs a slice")
    return spark.read.schema(made.schema).parquet(f"{found}/out")


def time_slices(events: DataFrame, n: int, ahead_s: float) -> Iterator[DataFrame]:
    """(case_id, activity, ts, event_idx) in n slices of equal time, then a row without case and activity ``ahead_s`` after the last.

    That row is no event; it moves the watermark on, so that all cases are closed.
    """
    rows = events.select(F.col("case_id").cast("string").alias("case_id"), "activity", F.timestamp_micros("us").alias("ts"), "event_idx", "us")
    first, last = rows.agg(F.min("us"), F.max("us")).first()
    if first is None:
        first = last = 0
    width = (last - first) // n + 1
    for k in range(n):
        yield rows.where((F.col("us") >= first + k * width) & (F.col("us") < first + (k + 1) * width)).drop("us")
    none = F.lit(None)
    yield rows.sparkSession.range(1).select(none.cast("string").alias("case_id"), none.cast("string").alias("activity"), F.timestamp_micros(F.lit(last + int(ahead_s * 1e6))).alias("ts"), none.cast("long").alias("event_idx"))
