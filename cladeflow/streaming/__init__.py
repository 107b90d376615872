"""A stream of alignment files through the batch operators. The data has no event time, so there is no watermark.

Operators on record sets need all rows of a query in one batch: a file must hold whole queries, as write_whole() deals
them; then no state is kept between batches, whatever files a batch takes. Row-wise operators take any files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeflow.runtime import scratch


def write_whole(rows: DataFrame, folder: str, files: int, keys: tuple[str, ...] = ("query_id",)) -> None:
    """Rows as files that hold whole queries."""
    rows.repartition(files, *keys).write.mode("append").parquet(folder)


def stream_operator(spark: SparkSession, folder: str, schema, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1000):
    """Start a query that reads parquet files as they come and writes the operator's rows of each batch once.

    A batch's rows go to a folder of its number, so that a batch run again after a failure replaces itself."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_stream(spark: SparkSession, rows: DataFrame, operator: Callable[[DataFrame], DataFrame], batches: int = 4) -> DataFrame:
    """All rows as a stream to its end, in some batches of files; there are as many files as a shuffle has partitions, so
    that a task's file grows no faster than these let it."""
    base = scratch(spark, "stream")
    files = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    write_whole(rows, f"{base}/in", files)
    stream_operator(spark, f"{base}/in", rows.schema, operator, f"{base}/out", f"{base}/check", files_per_batch=-(-files // batches)).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")
