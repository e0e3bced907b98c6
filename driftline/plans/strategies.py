"""Candidate tables, strategies, searches and forecast evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions.numbers import ordered_mean
from driftline.operators import asof, rolling, search
from driftline.plans.asof import ANCHOR, events
from driftline.plans.base import Plans, rounded, table

plans = Plans()


def _weekly(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumns({"role": F.col("user_id") % 5, "week": F.to_date(F.date_trunc("week", "ts"))})
    return df.groupBy("user_id", "role", "week", F.col("event_type").alias("item")).agg(F.count("*").alias("n"), F.sum("value").alias("points"))


def candidates(spark, sf_dir):
    df = search.feature_table(_weekly(spark, sf_dir), "user_id", "role", "week", "item")
    more = {"tier": 1 + (F.col("user_id") % 3) * 0.1, "priority": F.col("domestic_share"), "availability": 1 - 0.5 * F.col("leading_share"), "target_id": F.concat_ws("|", "user_id", "week")}
    return df.withColumns(more)


_CANDIDATES = """wk AS (SELECT user_id, user_id % 5 AS role, date_trunc('week', ts)::DATE AS week, event_type AS item, count(*) AS n, sum(value) AS points FROM events GROUP BY ALL),
gr AS (SELECT DISTINCT w.user_id, w.role, w.week, i.item FROM wk w, (SELECT DISTINCT item FROM wk) i),
ow AS (SELECT g.user_id, g.week, g.item, coalesce(sum(n), 0)::DOUBLE AS n FROM gr g LEFT JOIN wk w ON w.user_id = g.user_id AND w.item = g.item AND w.week < g.week GROUP BY ALL),
ro AS (SELECT g.role, g.week, g.item, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(points), 0) AS p FROM (SELECT DISTINCT role, week, item FROM gr) g LEFT JOIN wk w ON w.role = g.role AND w.item = g.item AND w.week < g.week GROUP BY ALL),
ev AS (SELECT g.week, g.item, coalesce(sum(n), 0)::DOUBLE AS n FROM (SELECT DISTINCT week, item FROM gr) g LEFT JOIN wk w ON w.item = g.item AND w.week < g.week GROUP BY ALL),
f1 AS (SELECT gr.*, coalesce(ow.n / nullif(sum(ow.n) OVER (PARTITION BY gr.user_id, gr.week), 0), 0) AS player_share, coalesce(ro.n / nullif(sum(ro.n) OVER (PARTITION BY gr.user_id, gr.week), 0), 0) AS domestic_share, coalesce(ev.n / nullif(sum(ev.n) OVER (PARTITION BY gr.user_id, gr.week), 0), 0) AS leading_share, sum(ro.n) OVER (PARTITION BY gr.user_id, gr.week) AS games,
 coalesce(ro.p / nullif(ro.n, 0), 0) AS expected_points, CASE WHEN ro.n = 0 THEN 1.7 WHEN ow.n = 0 THEN 1.5 ELSE 1.3 END::DOUBLE AS novelty, wk.n IS NOT NULL AS hit, wk.points / wk.n AS mean FROM gr JOIN ow USING (user_id, week, item) JOIN ro USING (role, week, item) JOIN ev USING (week, item) LEFT JOIN wk ON wk.user_id = gr.user_id AND wk.week = gr.week AND wk.item = gr.item),
ft AS (SELECT *, coalesce(mean, 0) * (novelty - 1) AS realized, (1 + (user_id % 3) * 0.1::DOUBLE) * (0.85 + 0.15 * domestic_share) * (1 - 0.5 * leading_share) AS factor FROM f1)"""


@plans.query("feature_table", f"WITH {_CANDIDATES} SELECT user_id, week, item, round_even(player_share, 8) AS player_share, round_even(domestic_share, 8) AS domestic_share, round_even(leading_share, 8) AS leading_share, games::BIGINT AS games, round_even(expected_points, 6) AS expected_points, novelty, hit, round_even(realized, 6) AS realized FROM ft")
def feature_table(spark, sf_dir):
    df = candidates(spark, sf_dir)
    return df.select("user_id", "week", "item", *(rounded(c, 8).alias(c) for c in search.FEATURES), F.col("domestic_games").alias("games"), rounded("expected_points", 6).alias("expected_points"), "novelty", "hit", rounded("realized", 6).alias("realized"))


_STRATEGIES = {
    "static": ((0.45, 0.25, 0.30), "0.45::DOUBLE * player_share + 0.25::DOUBLE * domestic_share + 0.30::DOUBLE * leading_share"),
    "dynamic": ((), "CASE WHEN games < 5 THEN 0.35::DOUBLE * player_share + 0.15::DOUBLE * domestic_share + 0.50::DOUBLE * leading_share WHEN games <= 15 THEN 0.45::DOUBLE * player_share + 0.25::DOUBLE * domestic_share + 0.30::DOUBLE * leading_share ELSE 0.55::DOUBLE * player_share + 0.30::DOUBLE * domestic_share + 0.15::DOUBLE * leading_share END"),
    "maturity_blend": ((0.45, 0.10, 0.45, 0.35, 0.40, 0.25, 400.0), "(0.45::DOUBLE - 0.10::DOUBLE * m) * player_share + (0.10::DOUBLE + 0.30::DOUBLE * m) * domestic_share + (0.45::DOUBLE - 0.20::DOUBLE * m) * leading_share"),
    "comfort_persistence": ((0.45, 0.25, 0.30, 1.5, 0.5, 400.0), "(0.45::DOUBLE * player_share + 0.25::DOUBLE * domestic_share + 0.30::DOUBLE * leading_share) * (1 + ((1 - m) * 1.5::DOUBLE + m * 0.5::DOUBLE) * player_share)"),
    "role_popularity": ((), "domestic_share"),
}


@plans.query("strategy_eval", f"WITH {_CANDIDATES}, mt AS (SELECT *, least(1.0, games / 400) AS m FROM ft), " + ", ".join(f"""s_{name} AS (SELECT '{name}' AS strategy, hit, realized FROM (SELECT *, ({sql}) * factor AS raw FROM mt) QUALIFY row_number() OVER (PARTITION BY user_id, week ORDER BY round_even(raw{'' if name == 'role_popularity' else ' * expected_points * (novelty - 1)'}, 9) DESC, item) = 1)""" for name, (_, sql) in _STRATEGIES.items()) + """
SELECT strategy, count(*) AS targets, round_even(avg(hit::INT), 6) AS hit_rate, round_even(avg(realized), 6) AS mean_bonus FROM (""" + " UNION ALL ".join(f"SELECT * FROM s_{n}" for n in _STRATEGIES) + ") GROUP BY 1")
def strategy_eval(spark, sf_dir):
    found, out = candidates(spark, sf_dir), None
    for name, (weights, _) in _STRATEGIES.items():
        part = search.best_candidates(found, name, weights).select(F.lit(name).alias("strategy"), "hit", "realized")
        out = part if out is None else out.unionByName(part)
    return search.evaluate(out, ["strategy"]).select("strategy", "targets", rounded("hit_rate", 6).alias("hit_rate"), rounded("mean_bonus", 6).alias("mean_bonus"))


_TRIALS = search.simplex_trials(40, 20260723)
_SEARCH = f"""tr(trial, wa, wb, wc) AS (VALUES {', '.join(f'({k}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)' for k, a, b, c in _TRIALS)}),
bs AS (SELECT trial, week, hit, realized FROM (SELECT *, (wa * player_share + wb * domestic_share + wc * leading_share) * factor * expected_points * (novelty - 1) AS s FROM ft, tr) QUALIFY row_number() OVER (PARTITION BY trial, user_id, week ORDER BY round_even(s, 9) DESC, item) = 1)"""


@plans.query("simplex_search", f"WITH {_CANDIDATES}, {_SEARCH} SELECT trial, count(*) AS targets, round_even(avg(hit::INT), 6) AS hit_rate, round_even(avg(realized), 6) AS mean_bonus FROM bs GROUP BY 1")
def simplex_search(spark, sf_dir):
    found = search.simplex_search(candidates(spark, sf_dir), _TRIALS)
    return found.select("trial", "targets", rounded("hit_rate", 6).alias("hit_rate"), rounded("mean_bonus", 6).alias("mean_bonus"))


@plans.query("confirmation", f"""WITH {_CANDIDATES}, {_SEARCH}, dv AS (SELECT trial, avg(hit::INT) AS h, avg(realized) AS r FROM bs WHERE week < '2024-01-15' GROUP BY 1 ORDER BY round_even(h, 9) DESC, round_even(r, 9) DESC, trial LIMIT 10), cf AS (SELECT trial, avg(hit::INT) AS h, avg(realized) AS r FROM bs WHERE week >= '2024-01-15' GROUP BY 1)
SELECT trial, round_even(dv.h, 6) AS development_hit_rate, round_even(dv.r, 6) AS development_bonus, round_even(cf.h, 6) AS confirmation_hit_rate, round_even(cf.r, 6) AS confirmation_bonus FROM dv JOIN cf USING (trial)""")
def confirmation(spark, sf_dir):
    found = candidates(spark, sf_dir)
    first = search.simplex_search(found.where(F.col("week") < F.lit("2024-01-15").cast("date")), _TRIALS)
    second = search.simplex_search(found.where(F.col("week") >= F.lit("2024-01-15").cast("date")), _TRIALS)
    first, second = (x.withColumns({c: rounded(c, 9) for c in ("hit_rate", "mean_bonus")}) for x in (first, second))
    best = search.confirm(first, second, 10)
    return best.select("trial", *(rounded(c, 6).alias(c) for c in ("development_hit_rate", "development_bonus", "confirmation_hit_rate", "confirmation_bonus")))


_GRID = search.comfort_grid([0.25, 0.5, 1.5], [0.0, 0.5], [40.0, 400.0])
_MATURITY = [(*t[:7], t[7] * 10) for t in search.maturity_trials(20, 20260723)]


def _searched_sql(name: str, trials: list[tuple], columns: list[str], shares: str) -> str:
    values = ", ".join("(" + ", ".join([str(t[0]), *(f"{v!r}::DOUBLE" for v in t[1:])]) + ")" for t in trials)
    return f"""WITH {_CANDIDATES}, tr(trial, {', '.join(columns)}) AS (VALUES {values}), bs AS (SELECT trial, hit, realized FROM (SELECT *, ({shares}) * factor * expected_points * (novelty - 1) AS s FROM (SELECT *, least(1.0, games / greatest(1.0, horizon)) AS m FROM ft, tr)) QUALIFY row_number() OVER (PARTITION BY trial, user_id, week ORDER BY round_even(s, 9) DESC, item) = 1)
SELECT trial, count(*) AS targets, round_even(avg(hit::INT), 6) AS hit_rate, round_even(avg(realized), 6) AS mean_bonus FROM bs GROUP BY 1"""


@plans.query("comfort_search", _searched_sql("comfort", [(k, *g) for k, g in enumerate(_GRID)], search.COMFORT, "(0.45::DOUBLE * player_share + 0.25::DOUBLE * domestic_share + 0.30::DOUBLE * leading_share) * (1 + ((1 - m) * early + m * mature) * player_share)"))
def comfort_search(spark, sf_dir):
    """The whole grid of comfort strengths."""
    found = search.comfort_search(candidates(spark, sf_dir), _GRID)
    return found.select("trial", "targets", rounded("hit_rate", 6).alias("hit_rate"), rounded("mean_bonus", 6).alias("mean_bonus"))


@plans.query("maturity_search", _searched_sql("maturity", _MATURITY, search.MATURITY, " + ".join(f"(early_{n} + (mature_{n} - early_{n}) * m) * {n}_share" for n in ("player", "domestic", "leading"))))
def maturity_search(spark, sf_dir):
    """Seeded trials of weights that move as a split matures."""
    found = search.maturity_search(candidates(spark, sf_dir), _MATURITY)
    return found.select("trial", "targets", rounded("hit_rate", 6).alias("hit_rate"), rounded("mean_bonus", 6).alias("mean_bonus"))


@plans.query("series_choices", """WITH ch AS (SELECT user_id, ts::DATE AS day, arg_max(event_type, (value, event_id)) AS item, count(*) AS games, 1.3 + 0.2 * (user_id % 3) AS multiplier FROM events WHERE event_id % 3 = 0 GROUP BY ALL), pl AS (SELECT user_id, ts::DATE AS day, event_type AS item, sum(value) AS points FROM events WHERE event_id % 3 > 0 GROUP BY ALL)
SELECT user_id, day, item, points IS NOT NULL AS hit, round_even(coalesce(points, 0) * (multiplier - 1)::DOUBLE / greatest(1, games), 6) AS realized FROM ch LEFT JOIN pl USING (user_id, day, item)""")
def series_choices(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    chosen = df.where("event_id % 3 = 0").groupBy("user_id", "day").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("item"), F.count("*").alias("games"))
    chosen = chosen.withColumn("multiplier", 1.3 + 0.2 * (F.col("user_id") % 3))
    played = df.where("event_id % 3 > 0").withColumnRenamed("event_type", "item")
    found = rolling.realized_bonus(chosen, played, ["user_id", "day"], "item", "value", "games", "multiplier")
    return found.select("user_id", "day", "item", "hit", rounded("realized", 6).alias("realized"))


@plans.query("backtest_errors", """WITH p AS (SELECT event_type, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS predicted, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM events)
SELECT event_type, count(*) AS observations, round_even(avg(abs(value - predicted)), 6) AS mae, round_even(sqrt(avg((value - predicted) * (value - predicted))), 6) AS rmse, round_even(avg(abs(value - baseline)), 6) AS baseline_mae FROM p WHERE predicted IS NOT NULL GROUP BY 1""")
def backtest_errors(spark, sf_dir):
    df = events(spark, sf_dir)
    window = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"predicted": asof.recent_mean(df, ["user_id"], ["us", "event_id"], "value", 5), "baseline": F.avg("value").over(window)}).where("predicted IS NOT NULL")
    found = asof.forecast_errors(df, ["event_type"], "predicted", "baseline", "value")
    return found.select("event_type", "observations", *(rounded(c, 6).alias(c) for c in ("mae", "rmse", "baseline_mae")))


@plans.query("slate_errors", "SELECT user_id, ts::DATE AS day, round_even(abs(avg(value) - avg(event_id % 100)), 6) AS error FROM events GROUP BY ALL HAVING count(*) = 5")
def slate_errors(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "guess": F.col("event_id") % 100})
    return asof.slate_errors(df, ["user_id", "day"], "guess", "value").select("user_id", "day", rounded("error", 6).alias("error"))


@plans.query("week_projection", f"""WITH p AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, 't' || (event_id % 3) AS opponent, event_id % 3 > 0 AS known, floor(avg(value)) AS projection, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, week, round_even(avg(projection), 1) AS projection, arg_min(n, CASE WHEN known THEN opponent ELSE '' END) AS n, count(DISTINCT CASE WHEN known THEN opponent END) AS scheduled_matchups FROM p GROUP BY ALL""")
def week_projection(spark, sf_dir):
    opponent = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("t"), F.col("event_id") % 3)).otherwise("")
    df = table(spark, sf_dir, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week"), opponent.alias("opponent")).agg(F.floor(ordered_mean("value", "ts", "event_id")).alias("projection"), F.count("*").alias("n"))
    return asof.opponents_mean(df, ["user_id", "week"], "opponent", ["projection"], ["n"], 1)


@plans.query("weekly_combine", """WITH p AS (SELECT user_id % 50 AS player, event_type AS item, user_id % 7 AS opponent, avg(value) AS share, sum(value) AS bonus FROM events GROUP BY ALL)
SELECT player, item, round_even(avg(share), 6) AS share, round_even(sum(bonus), 4) AS bonus, count(DISTINCT opponent) AS matchup_count FROM p GROUP BY ALL""")
def weekly_combine(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("player"), F.col("event_type").alias("item"), (F.col("user_id") % 7).alias("opponent")).agg(F.avg("value").alias("share"), F.sum("value").alias("bonus"))
    found = asof.weekly_combine(df, ["player", "item"], ["share"], ["bonus"], "opponent")
    return found.select("player", "item", rounded("share", 6).alias("share"), rounded("bonus").alias("bonus"), "matchup_count")


@plans.query("decayed_spread", """SELECT a.event_id, round_even(CASE WHEN count(b.value) > 0 THEN sqrt(greatest(0, sum(w * b.value * b.value) / sum(w) - pow(sum(w * b.value) / sum(w), 2))) END, 2) AS deviation FROM events a LEFT JOIN (SELECT *, pow(2, (epoch_us(ts) - 1704067200000000) / (5 * 86400000000.0)) AS w FROM events) b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 10 DAY GROUP BY 1""")
def decayed_spread(spark, sf_dir):
    df = asof.decayed_asof(events(spark, sf_dir), ["user_id"], "us", "value", 5, 10, ANCHOR)
    return df.select("event_id", rounded("deviation", 2).alias("deviation"))
