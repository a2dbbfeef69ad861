"""Message intake and daily counts as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.times import local_time
from ..operators.dashboard import status_counts
from ..session import shared_folder

#: How late a message may come: the span of the retry budget.
WATERMARK = "7 days"


def read_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """A table, one file or a folder of them, as a stream of its files, ``files`` at a time."""
    folder, _, name = path.rpartition("/")
    pattern = f"{folder}/[{name[0]}]{name[1:]}"  # a pattern may also name a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)


def first_deliveries(messages: DataFrame, keys: list[str], at: str = "received_at") -> DataFrame:
    """The first delivery of each key within the watermark, from bounded state; what comes later still is dropped.

    ``store_first_deliveries`` keeps all, however late.
    """
    timed = messages.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", WATERMARK)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_at")


def live_daily_counts(messages: DataFrame, tz: str) -> DataFrame:
    """Status counts per local day; a late message within the watermark gives its day again."""
    local = messages.withColumn("_at", local_time(F.col("received_at"), tz).cast("timestamp")).withWatermark("_at", WATERMARK)
    counted = local.groupBy(F.window("_at", "1 day")).agg(*status_counts(F.col("status")))
    return counted.withColumn("day", F.col("window.start").cast("date")).drop("window")


def store_first_deliveries(stream: DataFrame, keys: list[str], name: str = "deliveries") -> DataFrame:
    """All that is there now, each key once, however late it comes again.

    Each micro-batch leaves out what earlier ones have stored and writes its own folder by its number; one that is run again
    does not see its first run and replaces it.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    stored = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(keys)
        if number:
            earlier = [f"{base}/rows/batch={k}" for k in range(number)]
            new = new.join(batch.sparkSession.read.schema(stored).parquet(*earlier).select(*keys), keys, "left_anti").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stored).parquet(f"{base}/rows").select(*stream.columns)


def run_once(stream: DataFrame, keys: list[str] | None = None, name: str = "stream") -> DataFrame:
    """All that is there now, run as micro-batches into the shared folder; with ``keys`` the latest row of each.

    Each micro-batch writes its own folder by its number, so one that is run again after a failure replaces itself.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    mode = "update" if keys else "append"
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    columns = stream.columns
    rows = spark.read.option("basePath", f"{base}/rows").schema(stream.withColumn("_batch", F.lit(0)).schema).parquet(f"{base}/rows")
    if not keys:
        return rows.select(*columns)
    rest = [c for c in columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*keys, "_row.*")
