"""Queries over a scheduled market: customers as players of rounds that are not in the history."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import asof, market
from driftline.plans.asof import ANCHOR, events
from driftline.plans.base import Plans, micros, rounded, table

plans = Plans()

_ROLES = ("click", "view", "purchase", "error", "signup")


def history(spark, sf_dir):
    df = events(spark, sf_dir)
    return df.select(F.col("event_id").alias("row"), F.col("user_id").alias("entity"), F.col("event_type").alias("role"), (F.col("event_id") % 7).cast("string").alias("opponent"), F.col("us").alias("time"), "value", (F.col("event_id") % 5 == 0).alias("playoff"), (F.col("event_id") % 11 == 3).alias("domestic"))


def scheduled(spark, sf_dir):
    """Every customer in a round of its own cutoff, with none to two opponents."""
    key = F.col("c_custkey")
    role = F.element_at(F.array(*map(F.lit, _ROLES)), (F.floor(key / 200) % 5 + 1).cast("int"))
    opponents = F.when(key % 11 == 0, F.array().cast("array<string>")).when(key % 2 == 0, F.array((key % 7).cast("string"))).otherwise(F.array((key % 7).cast("string"), ((key + 3) % 7).cast("string")))
    locks = F.when(key % 3 == 0, F.lit("2024-01-15 00:00:00")).otherwise(F.lit("2024-01-25 12:00:00")).cast("timestamp_ntz")
    return table(spark, sf_dir, "customer").select(key.alias("id"), (key % 200).alias("entity"), role.alias("role"), F.col("c_nationkey").alias("team"), (key % 3 == 0).alias("early"), opponents.alias("opponents"), micros(locks).alias("cutoff"))


def projected(spark, sf_dir):
    found = market.project(history(spark, sf_dir), scheduled(spark, sf_dir), 5, 10, ANCHOR, 4, 6)
    return market.starters(found, ["early", "team", "role"])


#: A deviation, none where rounding is all there is of it.
_DEV = "CASE WHEN sum(w * value * value) / sum(w) - pow(sum(w * value) / sum(w), 2) > 1e-10 * sum(w * value * value) / sum(w) THEN sqrt(sum(w * value * value) / sum(w) - pow(sum(w * value) / sum(w), 2)) ELSE 0 END"
_MARKET = f"""m AS (SELECT c_custkey AS id, c_custkey % 200 AS entity, (['click', 'view', 'purchase', 'error', 'signup'])[c_custkey // 200 % 5 + 1] AS role, c_nationkey AS team, c_custkey % 3 = 0 AS early, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-15' ELSE TIMESTAMP '2024-01-25 12:00:00' END AS cutoff,
 CASE WHEN c_custkey % 11 = 0 THEN [] WHEN c_custkey % 2 = 0 THEN [c_custkey % 7] ELSE [c_custkey % 7, (c_custkey + 3) % 7] END AS opponents FROM customer),
s AS (SELECT *, unnest(CASE WHEN len(opponents) = 0 THEN [-1] ELSE opponents END) AS opponent, unnest(range(greatest(1, len(opponents)))) AS slot FROM m),
h AS (SELECT *, event_id % 7 AS opponent FROM events),
c AS (SELECT DISTINCT cutoff FROM m),
recent AS (SELECT c.cutoff, h.*, pow(0.5, (epoch_us(c.cutoff) - epoch_us(h.ts)) / (5 * 86400000000.0)) AS w FROM c JOIN h ON h.ts < c.cutoff AND h.ts >= c.cutoff - INTERVAL 10 DAY),
world AS (SELECT cutoff, avg(value) AS mean FROM recent GROUP BY 1),
role_any AS (SELECT cutoff, event_type AS role, sum(w * value) / sum(w) AS mean, {_DEV} AS dev FROM recent GROUP BY ALL),
role_home AS (SELECT cutoff, event_type AS role, sum(w * value) / sum(w) AS mean, {_DEV} AS dev FROM recent WHERE event_id % 11 = 3 GROUP BY ALL),
own AS (SELECT cutoff, user_id AS entity, event_type AS role, count(*) AS n, sum(w) AS w, sum(w * value) / sum(w) AS mean, {_DEV} AS dev, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi, max(ts) AS last,
 list_avg(list_slice(list(value ORDER BY ts DESC, event_id DESC), 1, 5)) AS last5 FROM recent GROUP BY ALL),
opp_any AS (SELECT cutoff, event_type AS role, opponent, sum(w) AS w, sum(w * value) / sum(w) AS mean FROM recent GROUP BY ALL),
opp_home AS (SELECT cutoff, event_type AS role, opponent, sum(w) AS w, sum(w * value) / sum(w) AS mean FROM recent WHERE event_id % 11 = 3 GROUP BY ALL),
h2h AS (SELECT cutoff, user_id AS entity, event_type AS role, opponent, sum(w) AS w, sum(w * value) / sum(w) AS mean FROM recent GROUP BY ALL),
po AS (SELECT cutoff, user_id AS entity, event_type AS role, sum(w) AS w, sum(w * value) / sum(w) AS mean FROM recent WHERE event_id % 5 = 0 GROUP BY ALL),
x AS (SELECT s.*, own.n, own.last, own.lo, own.hi, own.last5, coalesce(own.w, 0) AS ow, coalesce(rh.mean, ra.mean, world.mean, 0) AS base, coalesce(own.mean, rh.mean, ra.mean, world.mean, 0) AS mean, coalesce(own.dev, rh.dev, ra.dev) AS dev,
 CASE WHEN rh.mean IS NOT NULL THEN oh.mean ELSE oa.mean END AS om, coalesce(CASE WHEN rh.mean IS NOT NULL THEN oh.w ELSE oa.w END, 0) AS opw, h2h.mean AS hm, coalesce(h2h.w, 0) AS hw, po.mean AS pm, coalesce(po.w, 0) AS pw
 FROM s LEFT JOIN world USING (cutoff) LEFT JOIN role_any ra ON ra.cutoff = s.cutoff AND ra.role = s.role LEFT JOIN role_home rh ON rh.cutoff = s.cutoff AND rh.role = s.role LEFT JOIN own ON own.cutoff = s.cutoff AND own.entity = s.entity AND own.role = s.role
 LEFT JOIN opp_any oa ON oa.cutoff = s.cutoff AND oa.role = s.role AND oa.opponent = s.opponent LEFT JOIN opp_home oh ON oh.cutoff = s.cutoff AND oh.role = s.role AND oh.opponent = s.opponent
 LEFT JOIN h2h ON h2h.cutoff = s.cutoff AND h2h.entity = s.entity AND h2h.role = s.role AND h2h.opponent = s.opponent LEFT JOIN po ON po.cutoff = s.cutoff AND po.entity = s.entity AND po.role = s.role),
y AS (SELECT *, ow / (ow + 5) * mean + (1 - ow / (ow + 5)) * base AS shrunk, opw / (opw + 15) * (coalesce(om, base) - base) AS oe FROM x),
z AS (SELECT *, CASE WHEN hw > 0.5 THEN hw / (hw + 3) * (hm - shrunk) ELSE 0 END AS he, CASE WHEN pw > 1 THEN 0.2 * (pm / CASE WHEN mean > 0 THEN mean ELSE 1 END - 1) ELSE 0 END AS pe, CASE WHEN dev = 0 THEN 3 ELSE dev END AS sd FROM y),
p AS (SELECT *, shrunk + 0.35 * oe + 0.25 * he + shrunk * pe AS projection FROM z),
players AS (SELECT id, any_value(entity) AS entity, any_value(role) AS role, any_value(team) AS team, any_value(early) AS early, avg(round_even(projection, 4)) AS projected, avg(round_even(mean, 4)) AS recent, avg(round_even(coalesce(last5, mean), 4)) AS last5, avg(round_even(base, 4)) AS baseline, avg(round_even(0.35 * oe, 4)) AS opponent_adjustment, avg(round_even(0.25 * he, 4)) AS h2h_adjustment,
 avg(round_even(ow, 4)) AS effective_games, avg(round_even(CASE WHEN n >= 3 THEN lo ELSE greatest(0, projection - 1.28 * sd) END, 4)) AS floor, avg(round_even(CASE WHEN n >= 3 THEN hi ELSE projection + 1.28 * sd END, 4)) AS ceiling, coalesce(any_value(n), 0) AS games, arg_min(dev, slot) AS deviation, any_value(last) AS last, any_value(len(opponents)) AS matchups FROM p GROUP BY id),
started AS (SELECT *, row_number() OVER (PARTITION BY early, team, role ORDER BY last DESC NULLS LAST, games DESC, id) = 1 AS starter FROM players)"""


@plans.query("market_projection", f"""
WITH {_MARKET} SELECT id, {', '.join(f'round_even({c}, 6) AS {c}' for c in market.MEANS)}, games, round_even(deviation, 4) AS deviation, epoch_us(last) AS last_game, matchups AS scheduled_matchups, starter AS projected_starter FROM started""")
def market_projection(spark, sf_dir):
    return projected(spark, sf_dir).select("id", *market.MEANS, "games", "deviation", "last_game", F.col("scheduled_matchups").cast("long").alias("scheduled_matchups"), "projected_starter")


_FROM = "2024-01-21"


@plans.query("backtest_market", f"""
WITH h AS (SELECT *, event_id % 7 AS opponent FROM events), s AS (SELECT event_id AS id, user_id AS entity, event_type AS role, opponent, ts AS cutoff, 0 AS slot, value FROM h WHERE ts >= '{_FROM}' AND event_id % 11 = 3),
{{0}}
SELECT role, count(*) AS observations, round_even(avg(abs(value - round_even(projection, 4))), 6) AS mae, round_even(sqrt(avg(pow(value - round_even(projection, 4), 2))), 6) AS rmse, round_even(avg(abs(value - round_even(base, 4))), 6) AS baseline_mae FROM p GROUP BY role""".replace("{0}", _MARKET[_MARKET.index("c AS (") : _MARKET.index(",\nplayers AS")].replace("SELECT DISTINCT cutoff FROM m", "SELECT DISTINCT cutoff FROM s")))
def backtest_market(spark, sf_dir):
    """Errors of the projection on later domestic rows, each projected from what was known before it, beside the role's baseline."""
    known = history(spark, sf_dir)
    targets = known.where(F.col("domestic") & (F.col("time") >= micros(F.lit(_FROM).cast("timestamp_ntz")))).select(F.col("row").alias("id"), "entity", "role", F.array("opponent").alias("opponents"), F.col("time").alias("cutoff"), F.col("value").alias("actual"))
    found = market.project(known, targets, 5, 10, ANCHOR, 4)
    errors = asof.forecast_errors(found, ["role"], "projected", "baseline", "actual")
    return errors.select("role", "observations", *(rounded(c, 6).alias(c) for c in ("mae", "rmse", "baseline_mae")))


@plans.query("coach_projection", f"""
WITH {_MARKET}, k AS (SELECT n_nationkey AS team, unnest([true, false]) AS early FROM nation), t AS (SELECT early, team, avg(projected) AS projected, count(*) AS projected_players, string_agg(entity::VARCHAR, '|' ORDER BY role, id) AS starters FROM started WHERE starter GROUP BY ALL)
SELECT team, early, round_even(projected, 6) AS projected, coalesce(projected_players, 0) AS projected_players, coalesce(starters, '') AS starters FROM k LEFT JOIN t USING (team, early)""")
def coach_projection(spark, sf_dir):
    coach_rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), F.explode(F.array(F.lit(True), F.lit(False))).alias("early"))
    return market.coaches(projected(spark, sf_dir), coach_rows, ["early", "team"], 6).select("team", "early", "projected", "projected_players", "starters")
