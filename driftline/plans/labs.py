"""Profile documents: ten events are a game of two sides, forty players, and what each side denied."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import labs
from driftline.plans.base import Plans, table

plans = Plans()
_KEYS, _CONTEXT = ["player", "league", "phase", "position"], ["league", "phase"]
_ROWS = """r AS (SELECT event_id, event_id // 10 AS game, CASE WHEN event_id % 10 < 5 THEN 'Blue' ELSE 'Red' END AS side, 'p' || (user_id % 40) AS player, 'L' || (event_id // 10 % 2) AS league, CASE WHEN event_id // 10 % 3 = 0 THEN 'Spring' ELSE 'Summer' END AS phase, event_type AS position,
 'c' || (event_id * 7 % 40) AS champion, ((event_id // 10 + event_id % 10 // 5) % 2)::DOUBLE AS win, value, event_id % 1000 AS dpm, 't' || (user_id % 7) AS team, ts::DATE AS day, '15.' || (event_id // 10 % 4) AS patch FROM events),
sd AS (SELECT DISTINCT game, side, league, phase FROM r), bl AS (SELECT DISTINCT game, side, league, phase, 'c' || ((game * 3 + CASE side WHEN 'Blue' THEN 0 ELSE 11 END + k * 5) % 40) AS champion FROM sd, range(5) t(k)),
wh AS (SELECT player, league, phase, position, count(DISTINCT game) AS games, sum(win)::BIGINT AS wins, round_even(avg(win), 4) AS rate, round_even(avg(value), 6) AS points, min(day) AS lo, max(day) AS hi, string_agg(DISTINCT team, ',' ORDER BY team) AS teams FROM r GROUP BY ALL),
it AS (SELECT player, league, phase, position, champion, count(DISTINCT game) AS games, sum(win)::BIGINT AS wins, round_even(avg(value), 6) AS points, max(day) AS hi, string_agg(DISTINCT patch, ',' ORDER BY patch) AS patches FROM r GROUP BY ALL),
pk AS (SELECT player, league, phase, position, count(*) AS uniq, sum(CASE WHEN k <= 3 THEN n ELSE 0 END) AS top, string_agg(text, ' ' ORDER BY k) AS picks FROM (SELECT it.player, it.league, it.phase, it.position, it.games AS n, row_number() OVER (PARTITION BY it.player, it.league, it.phase, it.position ORDER BY it.games DESC, champion) AS k, concat_ws('/', champion, it.games, round_even(it.games::DOUBLE / wh.games, 4)::DECIMAL(9, 4), it.wins, it.points::DECIMAL(12, 6), it.hi, patches) AS text FROM it JOIN wh USING (player, league, phase, position)) GROUP BY ALL),
wb AS (SELECT league, phase, champion, count(*) AS n FROM bl GROUP BY ALL), ws AS (SELECT league, phase, count(*) AS n FROM sd GROUP BY ALL),
fa AS (SELECT player, league, phase, position, champion, count(DISTINCT game) AS n FROM (SELECT DISTINCT player, league, phase, position, game, side FROM r) x JOIN bl USING (game, league, phase) WHERE bl.side <> x.side GROUP BY ALL),
fb AS (SELECT fa.*, round_even(fa.n::DOUBLE / wh.games, 4) AS faced, round_even(wb.n::DOUBLE / ws.n, 4) AS usual, round_even(fa.n::DOUBLE / wh.games - wb.n::DOUBLE / ws.n, 4) AS lift FROM fa JOIN wh USING (player, league, phase, position) JOIN wb USING (league, phase, champion) JOIN ws USING (league, phase)),
bn AS (SELECT player, league, phase, position, string_agg(concat_ws('/', champion, n, faced::DECIMAL(9, 4), usual::DECIMAL(9, 4), lift::DECIMAL(9, 4)), ' ' ORDER BY lift DESC, n DESC, champion) AS bans FROM fb GROUP BY ALL),
og AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY player, league, phase, position) AS n FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY player, league, phase, position, game ORDER BY day, champion) = 1) WINDOW w AS (PARTITION BY player, league, phase, position ORDER BY day, game)),
sc AS (SELECT player, league, phase, position, CASE WHEN k <= (n + 1) // 2 THEN 'Early half' ELSE 'Late half' END AS label, champion, count(*) AS c FROM og GROUP BY ALL), sr AS (SELECT *, sum(c) OVER w AS total, row_number() OVER (PARTITION BY player, league, phase, position, label ORDER BY c DESC, champion) AS k FROM sc WINDOW w AS (PARTITION BY player, league, phase, position, label)),
sg AS (SELECT player, league, phase, position, string_agg(text, ' ' ORDER BY label) AS segments FROM (SELECT player, league, phase, position, label, concat_ws('/', label, any_value(total), count(*), round_even(sum(CASE WHEN k <= 3 THEN c ELSE 0 END)::DOUBLE / any_value(total), 4)::DECIMAL(9, 4), string_agg(champion || ':' || c || ':' || round_even(c::DOUBLE / total, 4)::DECIMAL(9, 4), ',' ORDER BY k) FILTER (k <= 5)) AS text FROM sr GROUP BY player, league, phase, position, label) GROUP BY ALL)"""
_SELECT = "SELECT player, league, phase, position, games, wins, rate AS win_rate, points, teams, lo AS first_day, hi AS last_day, uniq AS unique_items, round_even(top::DOUBLE / games, 4) AS concentration, CASE WHEN uniq <= 3 OR round_even(top::DOUBLE / games, 4) >= 0.75 THEN 'Concentrated' WHEN uniq >= 8 AND round_even(top::DOUBLE / games, 4) <= 0.55 THEN 'Wide' ELSE 'Balanced' END AS pool, picks, coalesce(bans, '') AS denied, segments FROM wh JOIN pk USING (player, league, phase, position) LEFT JOIN bn USING (player, league, phase, position) JOIN sg USING (player, league, phase, position)"


def _profiles(spark, sf_dir):
    number, game = F.col("event_id"), F.floor(F.col("event_id") / 10)
    blue = number % 10 < 5
    rows = table(spark, sf_dir, "events").select(
        number.alias("number"), game.alias("game"), F.when(blue, "Blue").otherwise("Red").alias("side"), F.concat(F.lit("p"), F.col("user_id") % 40).alias("player"), F.concat(F.lit("L"), game % 2).alias("league"), F.when(game % 3 == 0, "Spring").otherwise("Summer").alias("phase"), F.col("event_type").alias("position"),
        F.concat(F.lit("c"), number * 7 % 40).alias("champion"), ((game + F.when(blue, 0).otherwise(1)) % 2).cast("double").alias("win"), "value", (number % 1000).alias("dpm"), F.concat(F.lit("t"), F.col("user_id") % 7).alias("team"), F.to_date("ts").alias("day"), F.concat(F.lit("15."), game % 4).alias("patch"),
    )
    banned = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.concat(F.lit("c"), (F.col("game") * 3 + F.when(F.col("side") == "Blue", 0).otherwise(11) + k * 5) % 40))
    sides = rows.select("game", "side", *_CONTEXT).distinct().withColumn("bans", banned)
    return labs.profiles(rows, sides, _KEYS, _CONTEXT, "champion", "game", "side", "win", {"value": 6, "dpm": 1}, "team", "day", "patch", ["number"])


def _fixed(column, digits: int = 4):
    return column.cast(f"decimal(12, {digits})").cast("string")


def _text(found):
    picks = F.array_join(F.transform("picks", lambda x: F.concat_ws("/", x["champion"], x["games"], _fixed(x["share"]), x["wins"], _fixed(x["avg_value"], 6), x["last_seen"].cast("string"), F.array_join(x["versions"], ","))), " ")
    bans = F.array_join(F.transform("denied", lambda x: F.concat_ws("/", x["champion"], x["denied_games"], _fixed(x["faced_rate"]), _fixed(x["side_rate"]), _fixed(x["lift"]))), " ")
    top = lambda x: F.array_join(F.transform(x["top"], lambda t: F.concat_ws(":", t["champion"], t["games"], _fixed(t["share"]))), ",")
    halves = F.array_join(F.transform("segments", lambda x: F.concat_ws("/", x["label"], x["games"], x["items"], _fixed(x["concentration"]), top(x))), " ")
    shown = ["games", "wins", "win_rate", F.col("avg_value").alias("points"), F.array_join("teams", ",").alias("teams"), F.col("first_seen").alias("first_day"), F.col("last_seen").alias("last_day"), F.col("unique_items").cast("long").alias("unique_items"), "concentration", "pool"]
    return found.select(*_KEYS, *shown, picks.alias("picks"), bans.alias("denied"), halves.alias("segments"))


@plans.query("lab_profiles", f"WITH {_ROWS} {_SELECT}")
def lab_profiles(spark, sf_dir):
    """Every player's profile of a league, phase and position as one row with its nested tables, shown as text."""
    return _text(_profiles(spark, sf_dir))


@plans.query("lab_filters", f"WITH {_ROWS} SELECT player, position, games, pool, split_part(denied, '/', 1) AS most_denied, len(string_split(picks, ' ')) AS pool_size FROM ({_SELECT}) WHERE league = 'L1' AND phase = 'Spring' AND games >= 3 AND pool <> 'Concentrated'")
def lab_filters(spark, sf_dir):
    """The filters of a profile page over the nested table: one league and phase, players of some games, and what is denied to them most."""
    found = _profiles(spark, sf_dir).where("league = 'L1' AND phase = 'Spring' AND games >= 3 AND pool <> 'Concentrated'")
    return found.select("player", "position", "games", "pool", F.coalesce(F.get("denied", F.lit(0))["champion"], F.lit("")).alias("most_denied"), F.size("picks").cast("long").alias("pool_size"))
