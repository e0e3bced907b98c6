"""Streaming queries: events arrive in files by time, some of them a file late."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.plans.base import Plans, scratch, table
from driftline.streaming import pools, windows

plans = Plans()
#: Days of a file, and how late a row may be: a row of the last quarter day before a file's end comes with the next one.
_DAYS, _LATE = 8, "1 day"


def _stream(spark, sf_dir):
    """Events written as files that are read in order, one a batch; every seventh row of a file's last hours comes late."""
    path, events = scratch(spark, "stream"), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.unix_micros("ts") / 86_400_000_000 - F.floor(F.unix_date(F.lit("2024-01-01").cast("date")))
    late = (F.col("event_id") % 7 == 0) & (day % _DAYS > _DAYS - 0.25)
    sent = events.withColumn("_file", F.floor(day / _DAYS) + F.when(late, 1).otherwise(0))
    for number in [r["_file"] for r in sent.select("_file").distinct().orderBy("_file").collect()]:
        sent.where(F.col("_file") == number).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@plans.query("stream_running_pools", """
WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), m AS (SELECT e.*, (SELECT max(epoch_us(ts)) FROM events) - 86400000000 AS mark FROM e)
SELECT event_id AS row, user_id::VARCHAR AS key, event_type AS item, first_value(event_type) OVER w AS first_item, array_to_string(list_sort(coalesce(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), [])), ',') AS pool
FROM m WHERE us < mark // 1000 * 1000 WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def stream_running_pools(spark, sf_dir):
    """What a user has done before each event, as a stream gives it once the watermark has passed."""
    found = pools.drained(pools.running_pools(_stream(spark, sf_dir), "user_id", "event_id", "ts", "event_type", _LATE), scratch(spark, "pools"))
    return found.select("row", "key", "item", "first_item", F.array_join("pool", ",").alias("pool"))


@plans.query("stream_weekly", """
SELECT week, event_type, count(*) AS rows, round_even(sum(value), 4) AS total FROM (SELECT *, date_trunc('week', ts)::TIMESTAMP AS week FROM events) WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY week, event_type""")
def stream_weekly(spark, sf_dir):
    """Weeks that the watermark has closed."""
    found = pools.drained(windows.weekly(_stream(spark, sf_dir), "ts", ["event_type"], "value", _LATE), scratch(spark, "weeks"))
    return found.select(F.col("week").cast("timestamp_ntz").alias("week"), "event_type", "rows", F.bround("total", 4).alias("total"))
