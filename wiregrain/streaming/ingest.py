"""Incremental ingestion with Structured Streaming.

Entries arrive as files (or from the live source); an entry that was seen
before is ignored, the first version counts. Endpoint counts are kept as
streaming state and written per micro-batch, so nothing is held on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..sources.tables import scratch_path

KEY = ("host", "method", "path_template")


def entry_stream(spark: SparkSession, path: str, schema: object, files_per_trigger: int = 1_000) -> DataFrame:
    """New Parquet files below the folder ``path`` (or one file) as a stream of entries."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def first_versions(stream: DataFrame, late: str | None = None) -> DataFrame:
    """Each entry once. ``late`` (such as ``7 days``) bounds the state: duplicates may come that much later.

    Without it the ids of all entries are kept, in the state store on disk.
    """
    known = stream.where(F.col("entry_id").isNotNull())
    if late is None:
        return known.dropDuplicates(["entry_id"])
    at = F.coalesce(F.col("ingested_at").cast("timestamp"), F.timestamp_millis(F.col("timings.started_at")))
    return known.withColumn("_at", at).withWatermark("_at", late).dropDuplicatesWithinWatermark(["entry_id"]).drop("_at")


def endpoint_counts(stream: DataFrame) -> DataFrame:
    """Entries per host, method and path template, as a streaming aggregation."""
    url = F.coalesce(F.col("url"), F.lit(""))
    keyed = stream.select(urls.url_host(url).alias("host"), F.coalesce("request.method", F.lit("")).alias("method"), urls.path_template(urls.url_path(url)).alias("path_template"))
    return keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("count"))


def start_counts(counts: DataFrame, folder: str, interval: str | None = None) -> StreamingQuery:
    """Write the counts that change in each micro-batch below ``folder``; without an interval the available data are processed once.

    A repeated micro-batch overwrites its own files.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def current_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The latest count of each endpoint."""
    written = spark.read.parquet(f"{folder}/out")
    return written.groupBy(*KEY).agg(F.max_by("count", "epoch").alias("count"))


def replay_counts(spark: SparkSession, path: str) -> DataFrame:
    """Endpoint counts of a folder (or file) of entries, streamed to its end."""
    folder = scratch_path(spark, "stream")
    schema = spark.read.parquet(path).schema
    query = start_counts(endpoint_counts(first_versions(entry_stream(spark, path, schema))), folder)
    query.awaitTermination()
    return current_counts(spark, folder)


def time_windows(entries: DataFrame, width: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Entries per window of their start time and status class; works on tables and streams."""
    from ..functions.content import status_class

    at = F.timestamp_millis(F.col("timings.started_at")).alias("at")
    rows = entries.select(at, F.coalesce("response.status_code", F.lit(0)).alias("status")).where("at is not null")
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return rows.groupBy(window.alias("w"), status_class(F.col("status")).alias("status_class")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "status_class", "n")
