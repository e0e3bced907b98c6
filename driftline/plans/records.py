"""Record-level queries: scoring, normalisation, market documents, price history, versions and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import text
from driftline.operators import drafts, scoring
from driftline.operators import versions as ver
from driftline.plans.base import Plans, rounded, table
from driftline.sources import tables

plans = Plans()

#: Greatest value of each statistic that the lines of an order stand for; 0 and 1 are flags.
_RANGES = {
    "kills": 16, "deaths": 9, "assists": 14, "teamkills": 30, "firstblood": 2, "triplekills": 3, "quadrakills": 2, "pentakills": 2, "result": 2, "gamelength": 2600, "team_gold": 70000, "opponent_gold": 70000,
    "totalcs": 400, "golddiff14": 500, "csat15": 180, "barons_stolen": 2, "elders_stolen": 2, "dragons_stolen": 3, "heralds_stolen": 2, "solokills": 3, "damagetaken": 40000, "team_damagetaken": 100000, "team_dragons": 6, "team_barons": 3, "team_firstdragon": 2, "dpm": 1500, "vspm": 4,
}
_ROLES = ("top", "jgl", "mid", "bot", "sup")


def _stat(name: str, k: int) -> str:
    # gold in tens, so that points have two digits and rounding meets no ties
    return f"(l_orderkey * {2 * k + 3} + l_linenumber * {7 * k + 11} + l_partkey) % {_RANGES[name]}" + " * 10" * (name == "golddiff14")


_STATS_SQL = ", ".join(f"({_stat(n, k)})::DOUBLE AS {n}" for k, n in enumerate(_RANGES)) + ", ((l_partkey * 13 + l_linenumber) % 50) / 100.0::DOUBLE AS damageshare"


@plans.query("fantasy_points", f"""WITH s AS (SELECT l_orderkey, l_linenumber, ['top', 'jgl', 'mid', 'bot', 'sup'][(l_orderkey + l_linenumber) % 5 + 1] AS position, {_STATS_SQL} FROM lineitem), k AS (SELECT *, (kills + assists) / CASE WHEN teamkills = 0 THEN 1 ELSE teamkills END AS kp, csat15 / 15 AS cspm15 FROM s)
SELECT l_orderkey, l_linenumber, round_even(1.5 * kills - deaths + assists + 0.01 * totalcs + firstblood + 2 * (kp >= 0.70)::INT + 2 * triplekills + 3 * quadrakills + 5 * pentakills + 3 * (kills >= 10)::INT + 3 * (damageshare >= 0.30)::INT + (result = 1)::INT
 + 2 * (result = 1 AND ((gamelength > 0 AND gamelength < 1620) OR team_gold - opponent_gold >= 10000))::INT + 3 * (deaths = 0 AND kills + assists >= 5)::INT + greatest(0, golddiff14) / 1000 + 4 * barons_stolen + 4 * elders_stolen + 2 * dragons_stolen + 2 * heralds_stolen
 + CASE position WHEN 'top' THEN (solokills > 0)::INT + 2 * (damageshare >= 0.25)::INT + 2 * coalesce((damagetaken / nullif(team_damagetaken, 0) >= 0.25)::INT, 0) WHEN 'jgl' THEN 1.5 * (team_dragons >= 4)::INT + 2 * team_barons + 2 * (kp >= 0.75)::INT WHEN 'mid' THEN 3 * (damageshare >= 0.30)::INT + 1.5 * (cspm15 >= 10)::INT
  WHEN 'bot' THEN 1.5 * (cspm15 >= 10)::INT + (dpm >= 1000)::INT ELSE 2 * (assists >= 10)::INT + 2 * (kp >= 0.75)::INT + 1.5 * (team_firstdragon = 1)::INT + vspm END, 2) AS fantasy_pts FROM k""")
def fantasy_points(spark, sf_dir):
    stats = {n: F.expr(_stat(n, k)).cast("double") for k, n in enumerate(_RANGES)}
    position = F.element_at(F.array(*map(F.lit, _ROLES)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 5 + 1).cast("int"))
    df = table(spark, sf_dir, "lineitem").withColumns(stats | {"damageshare": ((F.col("l_partkey") * 13 + F.col("l_linenumber")) % 50) / 100.0, "position": position})
    found = scoring.fantasy_points(df.select("l_orderkey", "l_linenumber", "position", "damageshare", *stats))
    return found.select("l_orderkey", "l_linenumber", rounded("fantasy_pts", 2).alias("fantasy_pts"))


_TIERS, _ABROAD = ["N1", "N2", "N3"], ["N9"]


@plans.query("normalize_players", """WITH p AS (SELECT o_orderkey, 'N' || (o_custkey % 12) AS raw, CASE WHEN o_orderkey % 17 = 0 THEN 'Summer Showmatch' ELSE 'Summer' END AS split, ['top', 'jng', 'mid', 'bot', 'team', 'sup'][o_orderkey % 6 + 1] AS position, year(o_orderdate) AS year, 'T' || (o_custkey % 31) AS team FROM orders),
n AS (SELECT *, CASE raw WHEN 'N4' THEN 'N1' ELSE raw END AS league, CASE position WHEN 'jng' THEN 'jgl' ELSE position END AS role FROM p WHERE split NOT LIKE '%Showmatch%' AND position <> 'team'), t AS (SELECT league, year, team, count(*) AS n FROM n GROUP BY ALL), l(league, year, team) AS (VALUES ('N2', 1995, 'T3'), ('N2', 1995, 'T4'))
SELECT o_orderkey, n.league, raw AS source_league, role AS position FROM n JOIN t USING (league, year, team) WHERE n.league = 'N9' OR (n.league IN ('N1', 'N2', 'N3') AND (EXISTS (SELECT 1 FROM l WHERE l.league = n.league AND l.year = n.year AND l.team = n.team) OR (NOT EXISTS (SELECT 1 FROM l WHERE l.league = n.league AND l.year = n.year) AND t.n >= 18)))""")
def normalize_players(spark, sf_dir):
    position = F.element_at(F.array(*map(F.lit, ("top", "jng", "mid", "bot", "team", "sup"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    split = F.when(F.col("o_orderkey") % 17 == 0, "Summer Showmatch").otherwise("Summer")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("N"), F.col("o_custkey") % 12).alias("league"), split.alias("split"), position.alias("position"), F.year("o_orderdate").alias("year"), F.concat(F.lit("T"), F.col("o_custkey") % 31).alias("teamname"))
    primary = spark.createDataFrame([("N2", 1995, "T3"), ("N2", 1995, "T4")], "league string, year int, team string")
    roles = {"top": "top", "jng": "jgl", "mid": "mid", "bot": "bot", "sup": "sup"}
    return tables.normalize_players(rows, roles, {"N4": "N1"}, _TIERS, _ABROAD, primary).select("o_orderkey", "league", "source_league", "position")


#: Customer numbers that one market document covers.
_DOCUMENT = 5000


def market(spark, sf_dir):
    """Market documents of each nation, one for every so many customer numbers: its suppliers are teams, its customers players.

    A document names the teams that its players need, so that neither a row nor a document grows with the tables.
    """
    nation = Window.partitionBy("s_nationkey")
    place = F.row_number().over(nation.orderBy("s_suppkey")) - 1
    teams = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), place.alias("_place"), F.struct(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("C"), "s_suppkey").alias("code"), F.col("s_name").alias("name")).alias("_team"))
    sizes = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("_size"))
    # nations are few: their sizes go to all tasks
    customers = table(spark, sf_dir, "customer").join(F.broadcast(sizes), "c_nationkey")
    for name, shift in (("_pick", 0), ("_other", 1)):
        at = teams.select("c_nationkey", F.col("_place").alias(f"{name}_place"), F.col("_team").alias(name))
        customers = customers.withColumn(f"{name}_place", ((F.col("c_custkey") + shift) % F.col("_size")).cast("int")).join(at, ["c_nationkey", f"{name}_place"])
    player = F.struct(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("summonerName"), F.col("c_mktsegment").alias("role"), F.col("_pick.id").alias("teamId"),
        F.bround(F.col("c_acctbal") / 100, 1).alias("price"), F.bround(F.col("c_acctbal") / 110, 1).alias("previousPrice"), F.array("_other.id", "_pick.id").alias("opponentIds"),
    )
    text_of = F.to_json(F.struct(F.struct(F.col("c_nationkey").cast("string").alias("id"), F.concat(F.lit("Round "), "c_nationkey").alias("name")).alias("round"), "teams", "roundPlayers"))
    docs = customers.groupBy("c_nationkey", F.floor(F.col("c_custkey") / _DOCUMENT).alias("_part")).agg(F.array_distinct(F.flatten(F.collect_list(F.array("_pick", "_other")))).alias("teams"), F.collect_list(player).alias("roundPlayers"))
    return docs.select(F.from_json(text_of, tables.MARKET).alias("d")).select("d.*")


@plans.query("flatten_market", """WITH t AS (SELECT s_nationkey AS c_nationkey, list(s_suppkey ORDER BY s_suppkey) AS keys FROM supplier GROUP BY 1), p AS (SELECT c.*, keys[c_custkey % len(keys) + 1] AS team, keys[(c_custkey + 1) % len(keys) + 1] AS other, round_even(c_acctbal / 100, 1) AS price, round_even(c_acctbal / 110, 1) AS previous FROM customer c JOIN t USING (c_nationkey))
SELECT c_name AS summoner_name, 'Round ' || c_nationkey AS round_name, 'C' || team AS team_code, s_name AS team_name, 'C' || other || '|C' || team AS opponent_codes, round_even(price - previous, 2) AS price_change FROM p JOIN supplier ON s_suppkey = team""")
def flatten_market(spark, sf_dir):
    found = tables.flatten_market(market(spark, sf_dir), "2026-01-01 00:00:00")
    return found.select("summoner_name", "round_name", "team_code", "team_name", "opponent_codes", rounded("price_change", 2).alias("price_change"))


@plans.query("price_history", """WITH s AS (SELECT user_id, ts::DATE AS day, arg_max(value, (ts, -value)) AS price, max(ts) AS ts FROM events GROUP BY ALL) SELECT user_id::VARCHAR AS summoner_name, string_agg(day::VARCHAR || '=' || round_even(price, 2)::VARCHAR, ',' ORDER BY ts) AS path FROM s GROUP BY 1""")
def price_history(spark, sf_dir):
    shots = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("summoner_name"), F.to_date("ts").cast("string").alias("round_id"), F.lit("r").alias("round_name"), F.col("ts").alias("captured_at_utc"), F.col("value").alias("price"))
    path = F.transform("prices", lambda x: F.concat(x["round_id"], F.lit("="), F.bround(x["price"], 2).cast("string")))
    return tables.price_history(shots).select("summoner_name", F.array_join(path, ",").alias("path"))


@plans.query("latest_version", "SELECT coalesce(trim(arg_max(p_brand, (l_shipdate, p_brand)))) AS p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate < DATE '1997-01-01' AND l_returnflag = 'R'")
def latest_version(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_shipdate", "p_brand", "l_returnflag")
    return ver.latest_version(df, "l_shipdate", "p_brand", F.lit("1997-01-01").cast("date"), F.col("l_returnflag") == "R")


@plans.query("comfort_strength", "SELECT user_id, round_even((1 - m) * 1.5 + m * 0.25, 8) AS strength, round_even(total, 4) AS total, 0.3::DOUBLE AS patch_decay_rate FROM (SELECT user_id, least(1.0, count(*) / 40.0) AS m, sum(value) * 0.3 AS total FROM events GROUP BY 1)")
def comfort_strength(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), *((F.sum("value") * r).alias(ver.decay_column("total", r)) for r in (0.15, 0.3)))
    df = ver.select_decay(df, ["total"], 0.3)
    return df.select("user_id", rounded(ver.comfort_strength(F.col("n"), 1.5, 0.25, 40), 8).alias("strength"), rounded("total").alias("total"), "patch_decay_rate")


@plans.query("dashboard_split", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 IN (1, 2, 3) THEN ['Lock-In', 'Spring', 'Summer'][o_orderkey % 5] WHEN o_orderkey % 5 = 4 THEN 'Official Market' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'Week 1' ELSE 'Split ' || (o_orderkey % 5) || ' Round 1' END END AS split FROM orders""")
def dashboard_split(spark, sf_dir):
    number = F.col("o_orderkey") % 5
    name = F.when(number == 0, " Week 1 ").when(number == 4, "  ").otherwise(F.concat(F.lit("Split "), number, F.lit(" Round 1")))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "2026").otherwise("2025").alias("year"), name.alias("round_name"))
    return df.select("o_orderkey", text.dashboard_split("year", "round_name").alias("split"))


@plans.query("contested", """WITH o AS (SELECT DISTINCT ts::DATE AS day, user_id % 6 AS side, 5 - user_id % 6 AS opponent, event_type AS item FROM events WHERE event_id % 9 = 0) SELECT day, side, item, EXISTS (SELECT 1 FROM o b WHERE b.day = a.day AND b.side = a.opponent AND b.item = a.item) AS contested FROM o a""")
def contested(spark, sf_dir):
    item = F.when(F.col("user_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    df = table(spark, sf_dir, "events").where("event_id % 9 = 0").select(F.to_date("ts").alias("day"), (F.col("user_id") % 6).alias("side"), (5 - F.col("user_id") % 6).alias("opponent"), item.alias("item")).distinct()
    return drafts.contested(df, ["day"], "side", "opponent", "item").select("day", "side", F.lower("item").alias("item"), "contested")


@plans.query("price_detail", """WITH w AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY ALL) SELECT user_id, week, price, round_even(100 * (price - first_value(price) OVER (PARTITION BY user_id ORDER BY week)) / nullif(first_value(price) OVER (PARTITION BY user_id ORDER BY week), 0), 4) AS change_pct FROM w""")
def price_detail(spark, sf_dir):
    weeks = table(spark, sf_dir, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"))
    first = F.first("price").over(Window.partitionBy("user_id").orderBy("week"))
    return weeks.select("user_id", "week", "price", rounded(100 * F.try_divide(F.col("price") - first, first)).alias("change_pct"))


@plans.query("week_order", """SELECT week, row_number() OVER (ORDER BY regexp_extract(week, '([0-9]+)', 1)::INT, week)::INT AS place FROM (SELECT DISTINCT 'Week ' || ((ts::DATE - DATE '2024-01-01') // 2 + 1) AS week FROM events)""")
def week_order(spark, sf_dir):
    weeks = table(spark, sf_dir, "events").select(F.concat(F.lit("Week "), F.floor(F.datediff("ts", F.lit("2024-01-01")) / 2) + 1).alias("week")).distinct()
    # the names of weeks are few; one window numbers them
    return weeks.select("week", F.row_number().over(Window.orderBy(*text.natural_order("week"))).alias("place"))


@plans.query("candidate_union", """SELECT l_partkey AS item FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 48 UNION SELECT p_partkey FROM part WHERE p_size = 1""")
def candidate_union(spark, sf_dir):
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    sources = [lines.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("item")), lines.where("l_quantity > 48").select(F.col("l_partkey").alias("item")), part.where("p_size = 1").select(F.col("p_partkey").alias("item"))]
    return tables.union_all(sources).distinct()
