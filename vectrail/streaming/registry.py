"""The run registry as a stream: new rows are folded into the newest row of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectrail.operators.evaluate import latest_status
from vectrail.sources.readers import exists


def read_registry_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def keep_latest(stream: DataFrame, target: str, checkpoint: str, run: str = "run_id", at: str = "timestamp") -> StreamingQuery:
    """Keeps at ``target``/v=<batch> one row a run, the newest seen so far; a batch that is repeated writes the same."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{target}/v={number - 1}"
        rows = batch
        if number and exists(spark, before):
            rows = rows.unionByName(spark.read.parquet(before))
        latest_status(rows, run, at).write.mode("overwrite").parquet(f"{target}/v={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_windows(stream: DataFrame, at: str = "timestamp", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by status and time window; rows later than the watermark are left to the batch view."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "status").agg(F.count(F.lit(1)).alias("n"))
