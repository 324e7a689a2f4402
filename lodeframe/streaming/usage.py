"""Usage events and match records as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeframe.sources.files import MATCH

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Events from Parquet files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def match_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Match records from lines of JSON in files that arrive in a folder; bad lines are skipped."""
    text = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path)
    return text.select(F.from_json("value", MATCH, {"mode": "PERMISSIVE"}).alias("m")).filter("m.file is not null").select("m.*")


def alert_windows(events: DataFrame, late: str = "1 hour", width: str = "1 hour", least_failures: int = 5, least_rate: float = 0.1) -> DataFrame:
    """start, n, failed, level of the windows with many failures; also of a table.

    What comes later than ``late`` behind the newest event is dropped by the watermark,
    which also bounds the state: one row for each open window.
    """
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    rate = F.col("failed") / F.col("n")
    level = F.when((F.col("failed") >= 10 * least_failures) | (rate >= 0.25), "critical").when((F.col("failed") >= least_failures) | (rate >= least_rate), "warning")
    return counted.select(F.col("w.start").alias("start"), "n", "failed", level.alias("level")).filter("level is not null")


def append_operations(events: DataFrame, path: str, checkpoints: str) -> StreamingQuery:
    """Add each batch of events to a log once: a batch that is repeated after a failure replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoints).trigger(availableNow=True).start()


def alerts_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of all of ``events``, by the plan that the stream has."""
    return alert_windows(spark.read.parquet(f"{sf_dir}/events.parquet"))


FRAMES = {"m04_alert_windows": alerts_now}
FRAME_ORACLES = {
    "m04_alert_windows": "select start, n, failed, case when failed >= 50 or 1.0 * failed / n >= 0.25 then 'critical' else 'warning' end as level from (select date_trunc('hour', ts) as start, count(*) as n, count_if(event_type = 'error') as failed from events group by 1) t where failed >= 5 or 1.0 * failed / n >= 0.1"
}
