"""Running population counts over a stream of events: masks are stateless, only the counts are state.

Window counts need a watermark, so that state of closed windows goes; counts per sample are bounded by samples.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytora.functions.exprs import at_least
from cytora.session import shared_dir


def windowed(stream: DataFrame, masks: dict[str, Column], time: str, sample: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, sample, n_events, one count per mask) with late rows up to ``late`` behind the newest time."""
    counts = [F.sum(F.coalesce(m, F.lit(False)).cast("long")).alias(n) for n, m in masks.items()]
    return stream.withWatermark(time, late).groupBy(F.window(time, width), sample).agg(F.count(F.lit(1)).alias("n_events"), *counts)


def run_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily window counts of all events at hand, as a stream that ends, summed per sample."""
    at_rest = spark.read.parquet(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(at_rest.schema)
    one_file = all(f.rstrip("/").endswith("events.parquet") for f in at_rest.inputFiles())
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one_file else reader.parquet(f"{sf_dir}/events.parquet")
    timed = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("sample_id"), F.col("value").cast("float").cast("double").alias("value"))
    counts = windowed(timed, {"n_high": at_least(F.col("value"), 100.0)}, "ts", "sample_id", "1 day", "365 days")
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    table = f"{base}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.parquet(table)
    newest = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == newest).groupBy("sample_id").agg(F.sum("n_events").alias("n_events"), F.sum("n_high").alias("n_high"))
