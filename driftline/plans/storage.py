"""Sources and sinks over tables that a query writes to the shared folder first and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import text
from driftline.operators import scoring
from driftline.operators import sequences as seq
from driftline.plans.base import Plans, rounded, scratch, table
from driftline.plans.drafts import _ACTIONS, _GAMES, games, team_rows
from driftline.sources import tables

plans = Plans()


@plans.query("csv_union", """
SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey::VARCHAR END AS o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 2 THEN '15.' || (o_orderkey % 4) || '0' END AS patch FROM orders""")
def csv_union(spark, sf_dir):
    """CSV files of three different headers as one table."""
    orders, path = table(spark, sf_dir, "orders"), scratch(spark, "matches")
    patch = F.concat(F.lit("15."), F.col("o_orderkey") % 4, F.lit("0")).alias("patch")
    for number, columns in enumerate((["o_orderkey", "o_custkey"], ["o_orderstatus", "o_custkey", "o_orderkey"], [patch, "o_orderkey", "o_orderstatus"])):
        tables.export_csv(orders.where(F.col("o_orderkey") % 3 == number), f"{path}/{number}", columns)
    return tables.read_matches(spark, f"{path}/*/*.csv", required=("o_orderkey",)).select("o_orderkey", "o_custkey", "o_orderstatus", "patch")


@plans.query("team_drafts", f"""WITH {_GAMES} SELECT user_id * 100000 + block AS gameid, CASE s WHEN 0 THEN 'Blue' ELSE 'Red' END AS side, {', '.join(f"concat_ws(',', {', '.join(f'coalesce({k}[{n}], {chr(39)}{chr(39)})' for n in range(1, 6))}) AS {k}" for k in ('bans', 'picks'))} FROM tr WHERE user_id % 4 < 3""")
def team_drafts(spark, sf_dir):
    """The teams' rows of three leagues of four, their bans and picks as arrays of five."""
    df = team_rows(spark, sf_dir)
    wide = df.select("gameid", "side", "teamname", "date", "game", *(F.get(f"{k}s", F.lit(n - 1)).alias(f"{k}{n}") for k in ("ban", "pick") for n in range(1, 6)), F.concat(F.lit("L"), F.floor(F.col("gameid") / 100000) % 4).alias("league"), F.year("date").alias("year"), F.lit("15.1").alias("patch"), F.lit("Team").alias("position"))
    found = tables.team_drafts(wide, ["L0", "L1", "L2"])
    return found.select("gameid", "side", *(F.array_join(k, ",").alias(k) for k in ("bans", "picks")))


@plans.query("player_rows", "SELECT event_id AS gameid, 'u' || user_id AS playername, 'c' || (event_id % 9) AS champion FROM events WHERE event_id % 6 < 5 AND event_id % 9 > 0 AND user_id % 2 = 0")
def player_rows(spark, sf_dir):
    """Rows of players of known roles with a champion, of one league of two."""
    number = F.col("event_id")
    position = F.element_at(F.array(*map(F.lit, ("Top", "jng", "MID", "bot", "sup", "team"))), (number % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(number.alias("gameid"), F.concat(F.lit("L"), F.col("user_id") % 2).alias("league"), position.alias("position"), F.concat(F.lit("u"), "user_id").alias("playername"), F.when(number % 9 > 0, F.concat(F.lit("c"), number % 9)).otherwise(" ").alias("champion"))
    return tables.player_rows(rows, ["L0"], ["gameid", "playername", "champion"])


@plans.query("market_files", """
SELECT s_name AS summoner_name, 'code' || s_nationkey AS team_code, n_name AS team_name, round_even(s_acctbal, 4) AS price, round_even(s_acctbal - (s_acctbal + s_suppkey % 3), 4) AS price_change, 'code' || ((s_nationkey + 1) % 25) AS opponent_codes FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def market_files(spark, sf_dir):
    """A market document in a JSON file, read and flattened."""
    path = scratch(spark, "market")
    teams = table(spark, sf_dir, "nation").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("code"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))).alias("teams"))
    key = F.col("s_nationkey")
    players = table(spark, sf_dir, "supplier").agg(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("summonerName"), F.lit("mid").alias("role"), key.cast("string").alias("teamId"), F.col("s_acctbal").alias("price"), (F.col("s_acctbal") + F.col("s_suppkey") % 3).alias("previousPrice"), F.array(((key + 1) % 25).cast("string")).alias("opponentIds"))).alias("roundPlayers"))
    # one market is one document
    document = teams.join(players).select(F.struct(F.lit("r1").alias("id"), F.lit("Round 1").alias("name")).alias("round"), "teams", "roundPlayers")
    tables.export_json(document.coalesce(1), path)
    flat = tables.flatten_market(tables.read_market(spark, path), "2026-01-01T00:00:00Z")
    return flat.select("summoner_name", "team_code", "team_name", rounded("price").alias("price"), rounded("price_change").alias("price_change"), "opponent_codes")


@plans.query("latest_snapshot", "SELECT c_custkey, round_even(c_acctbal + 1, 2) AS price FROM customer WHERE c_custkey % 2 = 0")
def latest_snapshot(spark, sf_dir):
    """The last of three snapshots, none of which may be written twice."""
    customer, path = table(spark, sf_dir, "customer"), scratch(spark, "snapshots")
    for day, part, more in (("2024-01-01", F.lit(True), 0), ("2024-03-01", F.col("c_custkey") % 2 == 0, 1), ("2024-02-01", F.col("c_custkey") % 3 == 0, 2)):
        tables.write_snapshot(customer.where(part).select("c_custkey", rounded(F.col("c_acctbal") + more, 2).alias("price")), f"{path}/{day}")
    return tables.latest_snapshot(spark, path)


@plans.query("model_rows", f"""WITH {_ACTIONS}, pl AS (SELECT gameid, side, champion, min('p' || action_number) AS player, min('r' || action_number % 5) AS role FROM ac WHERE action_type = 'pick' GROUP BY ALL)
SELECT ac.gameid, action_number, ac.champion, pl.role, pl.player FROM ac LEFT JOIN pl ON pl.gameid = ac.gameid AND pl.side = ac.side AND pl.champion = ac.champion AND action_type IS NOT NULL""")
def model_rows(spark, sf_dir):
    """Draft tables by year, written with their keys checked, and read as a model's rows with each item's player."""
    drafts, path = games(spark, sf_dir), scratch(spark, "drafts")
    actions = seq.expand_drafts(drafts).withColumn("team", F.col("side"))
    players = actions.where("action_type = 'pick'").groupBy("gameid", "team", "champion").agg(F.min(F.concat(F.lit("p"), "action_number")).alias("player"), F.min(F.concat(F.lit("r"), F.col("action_number") % 5)).alias("role"))
    tables.write_draft_tables(drafts, actions, path)
    players.write.parquet(f"{path}/players")
    return tables.read_model_rows(spark, path, ["gameid", "action_number", "champion", "role", "player"])


@plans.query("missing_tables", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0")
def missing_tables(spark, sf_dir):
    """A table that is there, and an empty one in the place of one that is not."""
    path = scratch(spark, "orders")
    table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", "o_orderstatus").write.parquet(path)
    schema = "o_orderkey long, o_orderstatus string"
    return tables.read_or_empty(spark, path, schema).unionByName(tables.read_or_empty(spark, f"{path}-none", schema))


@plans.query("filtered_export", "SELECT c_name, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0")
def filtered_export(spark, sf_dir):
    """Chosen columns and rows as CSV with a header."""
    path = scratch(spark, "export")
    tables.export_csv(table(spark, sf_dir, "customer").where("c_acctbal > 0"), path, ["c_name", F.col("c_mktsegment").alias("segment")])
    return spark.read.option("header", True).schema("c_name string, segment string").csv(path)


@plans.query("json_export", "SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1")
def json_export(spark, sf_dir):
    """Rows with arrays as JSON lines."""
    path = scratch(spark, "json")
    tables.export_json(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("event_type")).alias("types")), path)
    return spark.read.schema("user_id long, n long, types array<string>").json(path).withColumn("types", F.array_join("types", ","))


@plans.query("cached_features", "SELECT user_id, count(*) AS n, 1::BIGINT AS builds FROM events GROUP BY 1")
def cached_features(spark, sf_dir):
    """A feature table that is built once for its key, and read the second time."""
    path, builds = scratch(spark, "cache"), []

    def build():
        builds.append(1)
        return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))

    key = {"rate": 0.3, "table": "events"}
    for _ in range(2):
        found = tables.cached_table(spark, path, key, build)
    return found.withColumn("builds", F.lit(len(builds)).cast("long"))


@plans.query("trial_log", "SELECT trial, count(*) AS rows, round_even(avg(value), 6) AS mean FROM (SELECT unnest([0, 1, 2]) AS trial), events WHERE event_id % 3 = trial GROUP BY 1")
def trial_log(spark, sf_dir):
    """Trials that are added to a table as they end."""
    path, events = scratch(spark, "trials"), table(spark, sf_dir, "events")
    for trial in range(3):
        tables.append_rows(events.where(F.col("event_id") % 3 == trial).agg(F.lit(trial).alias("trial"), F.count("*").alias("rows"), rounded(F.avg("value"), 6).alias("mean")), path)
    return spark.read.parquet(path)


@plans.query("name_functions", r"""
WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' Round ' || (event_id % 12) || ' Split ' || (event_id % 3 + 1) || ' ' WHEN 1 THEN 'Split ' || (event_id % 3 + 1) || '/Round 1' WHEN 2 THEN 'split 2 -- ROUND 1!' ELSE 'Split 3' END AS name, CASE event_id % 2 WHEN 0 THEN 'Blue' ELSE 'Red' END AS side, event_type, user_id FROM events)
SELECT event_id, trim(name) AS clean, lower(trim(name)) AS key, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE regexp_extract(name, '(?i)split\s+(\d+)', 1) WHEN '1' THEN 'Lock-In' WHEN '2' THEN 'Spring' ELSE 'Summer' END AS split, regexp_matches(name, '(?i)\bRound\s*1\b') AS opening,
 CASE side WHEN 'Blue' THEN event_type ELSE user_id::VARCHAR END AS own, CASE WHEN event_id % 5 = 0 THEN event_type ELSE event_type || ',x' END AS picks, event_type IN ('click', 'view') AND user_id BETWEEN 10 AND 50 AS inside FROM s""".replace("\\\\", "\\"))
def name_functions(spark, sf_dir):
    """Names cleaned, keyed, slugged and split; a row's own side, its set of picks, and its period."""
    number = F.col("event_id")
    name = F.when(number % 4 == 0, F.concat(F.lit(" Round "), number % 12, F.lit(" Split "), number % 3 + 1, F.lit(" "))).when(number % 4 == 1, F.concat(F.lit("Split "), number % 3 + 1, F.lit("/Round 1"))).when(number % 4 == 2, F.lit("split 2 -- ROUND 1!")).otherwise("Split 3")
    df = table(spark, sf_dir, "events").withColumns({"name": name, "side": F.when(number % 2 == 0, "Blue").otherwise("Red"), "user": F.col("user_id").cast("string"), "second": F.when(number % 5 == 0, F.concat(F.lit(" "), "event_type")).otherwise(F.lit("x "))})
    return df.select(
        "event_id", scoring.clean_text("name").alias("clean"), text.player_key("name").alias("key"), text.slug("name").alias("slug"), text.market_split(F.col("name"), {"1": "Lock-In", "2": "Spring", "3": "Summer"}).alias("split"), text.opening_round("name").alias("opening"),
        text.side_value(F.col("side"), F.col("event_type"), F.col("user")).alias("own"), F.array_join(text.pick_set("event_type", "second"), ",").alias("picks"), text.in_period(F.col("event_type"), F.col("user_id"), ["click", "view"], 10, 50).alias("inside"),
    )
