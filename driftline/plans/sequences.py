"""Session, pool, state and step queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import sequences as seq
from driftline.plans.base import Plans, micros, table

plans = Plans()
GAP = 12 * 3_600_000_000


def _events(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("us", micros("ts"))
    return seq.sessions(df, ["user_id"], "us", "event_id", GAP)


_SESSIONS = f"""(SELECT *, last_value(CASE WHEN fresh THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM
 (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {GAP}, true) AS fresh FROM events))"""


@plans.query("sessionize", f"SELECT event_id, user_id, session FROM {_SESSIONS}")
def sessionize(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "user_id", "session")


@plans.query("running_pool", f"""
SELECT a.event_id, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT b.event_type AS t FROM {_SESSIONS} b WHERE b.user_id = a.user_id AND b.session = a.session AND (b.ts, b.event_id) < (a.ts, a.event_id))), '') AS pool FROM {_SESSIONS} a""")
def running_pool(spark, sf_dir):
    window = seq.earlier(["user_id", "session"], ["us", "event_id"])
    return _events(spark, sf_dir).select("event_id", F.array_join(seq.running_pool(F.array("event_type"), window), ",").alias("pool"))


@plans.query("prior_state", """
SELECT conv_id, turn, coalesce(string_agg(CASE WHEN role = 'user' THEN turn::VARCHAR END, ',') OVER w, '') AS asked, coalesce(string_agg(CASE WHEN role = 'assistant' THEN length(text)::VARCHAR END, ',') OVER w, '') AS answered
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_state(spark, sf_dir):
    window = seq.earlier(["conv_id"], ["turn"])
    asked = seq.prior(F.col("turn").cast("string"), F.col("role") == "user", window)
    answered = seq.prior(F.length("text").cast("string"), F.col("role") == "assistant", window)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(asked, ",").alias("asked"), F.array_join(answered, ",").alias("answered"))


@plans.query("legality", f"""
WITH s AS (SELECT * FROM {_SESSIONS})
SELECT event_id, concat_ws(',', CASE WHEN EXISTS (SELECT 1 FROM s b WHERE b.user_id = a.user_id AND b.session = a.session AND b.event_type = a.event_type AND (b.ts, b.event_id) < (a.ts, a.event_id)) THEN 'current_draft_duplicate' END,
 CASE WHEN a.event_type = 'error' AND EXISTS (SELECT 1 FROM s b WHERE b.user_id = a.user_id AND b.session < a.session AND b.event_type = 'error') THEN 'fearless_unavailable' END) AS conflicts FROM s a""")
def legality(spark, sf_dir):
    drafted = seq.prior("event_type", F.lit(True), seq.earlier(["user_id", "session"], ["us", "event_id"]))
    first = F.min(F.when(F.col("event_type") == "error", F.col("session"))).over(seq.earlier(["user_id"], ["us", "event_id"]))
    df = _events(spark, sf_dir).withColumns({"drafted": drafted, "first": first})
    pool = F.when(F.col("first") < F.col("session"), F.array(F.lit("error"))).otherwise(F.array().cast("array<string>"))
    return df.select("event_id", seq.conflicts("event_type", F.col("drafted"), pool).alias("conflicts"))


@plans.query("change_points", """
SELECT event_id, user_id, previous, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous <> event_type""")
def change_points(spark, sf_dir):
    df = seq.change_points(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return df.select("event_id", "user_id", "previous", "event_type")


@plans.query("series_targets", f"""
SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(DISTINCT event_id) AS games, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS played, arg_max(event_type, (ts, event_id)) AS last_type FROM {_SESSIONS} GROUP BY ALL""")
def series_targets(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id", "session").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_distinct("event_id").alias("games"),
        F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("played"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
    )


@plans.query("weekly_targets", """
WITH e AS (SELECT *, date_trunc('week', ts)::TIMESTAMP AS week FROM events), f AS (SELECT user_id, week, event_type, min(ts) AS m, arg_min(event_id, ts) AS i FROM e GROUP BY ALL)
SELECT user_id, week, locked, first_type, played, week = min(week) OVER (PARTITION BY user_id) AS opening_week FROM (SELECT user_id, week, min(m) AS locked, arg_min(event_type, (m, i)) AS first_type, string_agg(event_type, ',' ORDER BY m, i) AS played FROM f GROUP BY ALL)""")
def weekly_targets(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("week", F.date_trunc("week", "ts").cast("timestamp_ntz"))
    df = df.groupBy("user_id", "week").agg(F.min("ts").alias("locked"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.array_join(seq.ordered_distinct(["ts", "event_id"], "event_type"), ",").alias("played"))
    return df.withColumn("opening_week", F.col("week") == F.min("week").over(seq.Window.partitionBy("user_id")))
