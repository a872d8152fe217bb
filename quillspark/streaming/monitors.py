"""Streaming monitors over crawl logs: alert windows, throttles, de-duplication, and how a stream is driven into a table.

Logs have domain, ts, result. Watermarks bound the state of windows. State machines are in `machines`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def alerts(log: DataFrame, span: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Failures and requests per domain and window."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", span).alias("w"), "domain").agg(F.count("*").alias("requests"), F.count_if(F.col("result") == "failed").alias("failures")).select("domain", F.col("w.start").alias("started"), "requests", "failures")


def throttle(log: DataFrame, most: int = 30, span: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Windows in which a domain failed more than `most` times."""
    failed = log.where("result = 'failed'").withWatermark("ts", late)
    return failed.groupBy(F.window("ts", span).alias("w"), "domain").agg(F.count("*").alias("failures")).where(F.col("failures") > most).select("domain", F.col("w.start").alias("started"), "failures")


def once(log: DataFrame, key: str = "url", within: str = "20 seconds") -> DataFrame:
    """The first row of each key inside the watermark: a response cache's hits go."""
    return log.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Drives a stream over what is there now into a table below `folder` (shared by all executors): a micro-batch writes its
    own part, or the whole table anew in complete mode, so a repeated batch replaces what it wrote before. Called again with
    the same folder, also after a failure, it goes on from the checkpoint there."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{folder}/rows/none")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{'all' if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/*")
