"""Mobility edges as a stream: the batch operators' filters, kept per event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import clean_edges

EDGE_SCHEMA = "edge_id bigint, src_zip string, dst_zip string, weight double, observed_at timestamp_ntz, loaded_at timestamp_ntz"


def read_edges(spark: SparkSession, folder: str, fmt: str = "parquet", files_per_trigger: int = 100, schema: str = EDGE_SCHEMA) -> DataFrame:
    """A stream of the edge files arriving in ``folder``; a single file is a stream of one."""
    source = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(path):
        return source.option("pathGlobFilter", path.getName()).load(path.getParent().toString())
    return source.load(folder)


def windowed_flows(edges: DataFrame, window: str = "1 day", lateness: str = "7 days", threshold: float = 0.0) -> DataFrame:
    """(start, src_zip, dst_zip, n, weight) by event-time window of ``observed_at``.

    Rows later than ``lateness`` behind the newest are dropped by the watermark,
    repeated edge_ids inside it count once. State is bounded by the pairs active
    within the lateness. Works on a bounded table too (nothing is then late).
    """
    timed = clean_edges(edges, threshold).withColumn("_at", F.col("observed_at").cast("timestamp"))
    if edges.isStreaming:
        fresh = timed.withWatermark("_at", lateness).dropDuplicatesWithinWatermark(["edge_id"])
    else:
        fresh = timed.dropDuplicates(["edge_id"])
    grouped = fresh.groupBy(F.window("_at", window).alias("_w"), "src_zip", "dst_zip")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).select(F.col("_w.start").alias("start"), "src_zip", "dst_zip", "n", "weight")


def write_flows(flows: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Append closed windows to Parquet; with ``once`` all available input is taken and the query ends."""
    writer = flows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(out)
