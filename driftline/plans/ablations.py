"""Ablation of the chance of winning: ten events are a game, its halves the sides, and a side's five events a slate."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import ablation, asof, folds
from driftline.plans.asof import ANCHOR, events
from driftline.plans.asof import plans as asof_plans
from driftline.plans.base import Plans, rounded, stored

plans = Plans()
_ENDS = {"development": "2024-01-12", "confirmation": "2024-01-18", "validation": "2024-01-24", "test": "2024-02-10"}


def _rows(spark, sf_dir):
    """Events with their projection, game, side, chance of winning known before the game, and window of days."""
    df = events(spark, sf_dir)
    projected = asof.projection(df.withColumn("opponent", F.col("event_id") % 7), "event_id", "user_id", "event_type", "opponent", F.col("event_id") % 5 == 0, "us", "value", 5, 10, ANCHOR, F.col("event_id") % 11 == 3).select("event_id", "projection")
    game, side = F.floor(F.col("event_id") / 10), F.when(F.col("event_id") % 10 < 5, 0).otherwise(1)
    df = df.withColumns({"game": game, "side": side})
    team = lambda s: ((F.col("game") * 3 + s * 5) % 12).alias(f"side_{'ab'[s]}")
    matches = df.groupBy("game").agg(*(F.sum(F.when(F.col("side") == s, F.col("value"))).alias(f"v{s}") for s in (0, 1))).where("v0 IS NOT NULL AND v1 IS NOT NULL")
    matches = matches.select(F.lit("all").alias("pool"), "game", team(0), team(1), (F.col("v0") > F.col("v1")).cast("double").alias("a_win"))
    rated = folds.elo(matches, "pool", ["game"]).select("game", "p_a")
    day = F.col("ts").cast("date")
    window = F.coalesce(*(F.when(day < F.lit(end).cast("date"), name) for name, end in _ENDS.items()))
    chance = F.when(F.col("side") == 0, F.col("p_a")).otherwise(1 - F.col("p_a"))
    return df.withColumn("window", window).where("window IS NOT NULL").join(projected, "event_id").join(rated, "game", "left").select("event_id", "window", "game", "side", F.col("event_type").alias("role"), "value", "projection", chance.alias("chance"))


def _adjusted(spark, sf_dir):
    rows = stored(_rows(spark, sf_dir), "projected")
    beta = ablation.coefficient(rows.where("window = 'development'").withColumn("chance", F.coalesce("chance", F.lit(0.5))), "value", "projection", "chance")
    return ablation.adjusted(rows, "projection", "chance", beta), beta


_PROJECTED = "SELECT event_id, projection FROM" + asof_plans.sql["projection"].split("AS ceiling FROM", 1)[1]
_WINDOW = "CASE " + " ".join(f"WHEN ts::DATE < DATE '{end}' THEN '{name}'" for name, end in _ENDS.items()) + " END"
_ROWS = f"""WITH RECURSIVE pj AS MATERIALIZED ({_PROJECTED}), e AS (SELECT *, event_id // 10 AS game, CASE WHEN event_id % 10 < 5 THEN 0 ELSE 1 END AS side FROM events),
m AS (SELECT game, (game * 3) % 12 AS a, (game * 3 + 5) % 12 AS b, (sum(CASE WHEN side = 0 THEN value END) > sum(CASE WHEN side = 1 THEN value END))::INT::DOUBLE AS win FROM e GROUP BY game HAVING count(DISTINCT side) = 2), mk AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY game) AS k FROM m),
f(k, game, ra, rb, state) AS (SELECT 0::BIGINT, -1::BIGINT, 0::DOUBLE, 0::DOUBLE, MAP {{}}::MAP(BIGINT, DOUBLE) UNION ALL SELECT k, game, ra, rb, map_concat(state, MAP {{a: ra + 32 * (win - p), b: rb - 32 * (win - p)}}) FROM (SELECT *, 1 / (1 + pow(10, (rb - ra) / 400)) AS p FROM (SELECT mk.*, f.state, coalesce(f.state[mk.a], 1500) AS ra, coalesce(f.state[mk.b], 1500) AS rb FROM f JOIN mk ON mk.k = f.k + 1))),
pr AS (SELECT game, 1 / (1 + pow(10, (rb - ra) / 400)) AS p FROM f WHERE k > 0),
x AS (SELECT event_id, {_WINDOW} AS win_window, game, side, event_type AS role, value, projection, coalesce(CASE WHEN side = 0 THEN p ELSE 1 - p END, 0.5) AS chance FROM e JOIN pj USING (event_id) LEFT JOIN pr USING (game)),
be AS (SELECT sum((chance - 0.5) * (value - projection)) / sum(pow(chance - 0.5, 2)) AS beta FROM x WHERE win_window = 'development'),
y AS (SELECT x.*, round_even(projection, 2) AS off, round_even(projection + beta * (chance - 0.5), 2) AS "on" FROM x, be WHERE win_window IS NOT NULL),
rk AS (SELECT *, {', '.join(f'rank() OVER (PARTITION BY win_window ORDER BY {c}) + (count(*) OVER (PARTITION BY win_window, {c}) - 1) / 2.0 AS r_{n}' for n, c in (('v', 'value'), ('off', 'off'), ('on', '"on"')))} FROM y),
co AS (SELECT win_window, count(*) AS slates, {', '.join(f'avg(abs(v - {w})) AS coach_{w[0:3].strip(chr(34)) if w == "off" else "on"}' for w in ('off', '"on"'))} FROM (SELECT win_window, game, side, avg(value) AS v, avg(off) AS off, avg("on") AS "on" FROM y GROUP BY ALL HAVING count(*) = 5) GROUP BY 1),
st AS (SELECT win_window, count(*) AS observations, {', '.join(f'avg(abs(value - {c})) AS mae_{n}, sqrt(avg(pow(value - {c}, 2))) AS rmse_{n}, corr(value, {c}) AS pearson_{n}, corr(r_v, r_{n}) AS spearman_{n}' for n, c in (('off', 'off'), ('on', '"on"')))} FROM rk GROUP BY 1),
sh AS (SELECT win_window, observations, slates, {', '.join(f'round_even({m}_{w}, 8) AS {m}_{w}' for m in (*ablation.METRICS, 'coach') for w in ('off', 'on'))} FROM st JOIN co USING (win_window)),
dl AS (SELECT *, {', '.join(f'round_even({m}_on - {m}_off, 8) AS {m}_delta' for m in ('mae', 'rmse', 'pearson'))} FROM sh)"""


@plans.query("win_chance_ablation", f'{_ROWS} SELECT win_window AS "window", * EXCLUDE (win_window) FROM dl')
def win_chance_ablation(spark, sf_dir):
    """Errors and correlations of the projection without and with the chance of winning, in each window."""
    return ablation.by_window(_adjusted(spark, sf_dir)[0], "value", ["game", "side"], 8)


@plans.query("win_chance_by_role", f'{_ROWS} SELECT win_window AS "window", role, round_even(avg(abs(value - off)), 8) AS mae_off, round_even(avg(abs(value - "on")), 8) AS mae_on FROM y GROUP BY ALL')
def win_chance_by_role(spark, sf_dir):
    return ablation.by_role(_adjusted(spark, sf_dir)[0], "value", "role", 8)


@plans.query("win_chance_gate", f"""{_ROWS}, g AS (SELECT coalesce(bool_or(CASE WHEN win_window = 'confirmation' THEN mae_delta < 0 AND rmse_delta <= 0.01 END), false) AS confirmed, coalesce(bool_or(CASE WHEN win_window = 'validation' THEN mae_delta < 0 AND rmse_delta <= 0.01 END), false) AS validated FROM dl)
SELECT confirmed, validated, confirmed AND validated AS passed, round_even(beta, 6) AS beta FROM g, be""")
def win_chance_gate(spark, sf_dir):
    """Whether the chance of winning is to be part of the projection, and what it is worth."""
    rows, beta = _adjusted(spark, sf_dir)
    return ablation.gate(ablation.by_window(rows, "value", ["game", "side"], 8), "confirmation", "validation").withColumn("beta", rounded(F.lit(beta), 6))
