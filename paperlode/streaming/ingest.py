"""Structured Streaming: continuous ingestion of files and windowed counts of events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _workspace(spark: SparkSession) -> str:
    """A folder that driver and executors share, as spark.checkpoint.dir names it. Where it is unset, a temporary one in a
    session of one machine, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="paperlode-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def hourly(events: DataFrame) -> DataFrame:
    """Counts and sums by hour and type; the watermark bounds the state to a day of hours."""
    window = F.window("ts", "1 hour")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def event_counts(spark: SparkSession, path: str) -> DataFrame:
    """Runs the stream over all files that are there and returns the result. A last micro-batch's open windows are part of it (update mode, latest version of each window)."""
    at = _workspace(spark)
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    single = path.endswith(".parquet") and not _is_directory(spark, path)
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if single else spark.readStream.schema(schema).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream = hourly(source).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    return rows.groupBy("hour", "event_type").agg(F.max_by(F.struct("n", "total"), "version").alias("r")).select("hour", "event_type", "r.n", "r.total")


def ingest_markdown(store, folder: str, checkpoint: str, **options):
    """Indexes the .md files of a folder, and those that come later, as a stream: every micro-batch is one commit of the store,
    and a batch that runs again after a failure finds its files unchanged. Returns the started query (all files now, then it ends)."""
    from ..sources.markdown import as_files

    files = store.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(folder)

    def commit(batch: DataFrame, number: int) -> None:
        store.add_files(as_files(batch), **options)

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(commit).trigger(availableNow=True).start()


def _is_directory(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
