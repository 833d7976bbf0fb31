"""The style audit on streams: rows are audited as they come, and totals are kept by windows of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import audit as A
from ..session import shared_folder


def audited(stream: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stateless, so it runs on batches and streams alike."""
    base = stream.select(*keep, *(c.alias(n) for n, c in A.audit(F.col(text)).items()))
    return base.withColumn("triggers", A.triggers()).withColumn("score", A.score()).withColumn("level", A.level())


def windowed_scores(stream: DataFrame, text: str, at: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Records, the highest score and total triggers by window; rows later than the watermark are left out."""
    stream = stream.withColumn(at, F.col(at).cast("timestamp"))
    return audited(stream.withWatermark(at, late), text, (at,)).groupBy(F.window(at, window).alias("w")).agg(F.count("*").alias("records"), F.max("score").alias("most"), F.sum("triggers").alias("triggers")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "records", "most", "triggers")


def replay(spark: SparkSession, path: str, text: str, at: str, window: str = "1 day") -> DataFrame:
    """A Parquet file as a stream, run to its end; the result is the table that the stream writes.

    Executors write each batch's windows as Parquet in the shared folder, beside the stream's own checkpoint, so a run
    goes on where it was lost and no window passes through the driver.
    """
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder) if file.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    out = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    windows = windowed_scores(stream.where(F.col(at).isNotNull()), text, at, late="30 days", window=window)

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/windows")

    query = windows.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").foreachBatch(store).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(windows.schema).parquet(f"{out}/windows")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
