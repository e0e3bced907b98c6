"""Hand-computed cases of single operators."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import text
from driftline.operators import asof, context, folds, lineup, models, profiles, ranking, scoring, sequences, vectors, versions
from driftline.plans import registry
from driftline.sources import tables
from driftline.streaming import windows


def one(df):
    return df.first().asDict()


def test_later_rows_never_count(spark):
    day = asof.DAY
    df = spark.createDataFrame([("a", 0, 10.0), ("a", day, 20.0), ("a", day, 30.0), ("a", 2 * day, 99.0)], "k string, t long, v double")
    got = asof.decayed_asof(df, ["k"], "t", "v", 1.0, 10, 0).orderBy("t", "v").collect()
    assert got[0]["mean"] is None and got[0]["rows"] == 0
    assert got[1]["mean"] == 10 and got[2]["mean"] == 10  # peers are left out
    assert got[3]["mean"] == pytest.approx((10 * 0.25 + 20 * 0.5 + 30 * 0.5) / 1.25)
    assert got[3]["weight"] == pytest.approx(1.25)


def test_projection_falls_back_to_role(spark):
    df = spark.createDataFrame([(1, "a", "top", "x", 0, 10.0, True), (2, "b", "top", "y", 5, 0.0, False), (3, "c", "top", "y", 9, 4.0, False), (4, "d", "mid", "z", 12, 1.0, True)], "n int, e string, r string, o string, t long, v double, h boolean")
    got = asof.projection(df, "n", "e", "r", "o", F.lit(False), "t", "v", 180, 730, 0).orderBy("t").collect()
    assert got[0]["projection"] == 0 and got[1]["projection"] == pytest.approx(10)
    # spread of one row is nothing, which counts as 3
    assert got[1]["ceiling"] == pytest.approx(10 + 1.28 * 3) and got[0]["ceiling"] is None
    # a role without rows takes the plain mean of all
    assert got[3]["projection"] == pytest.approx(14 / 3)
    # domestic rows alone make the role, if there are any
    got = asof.projection(df, "n", "e", "r", "o", F.lit(False), "t", "v", 180, 730, 0, F.col("h")).orderBy("t").collect()
    assert got[2]["projection"] == pytest.approx(10) and got[3]["projection"] == pytest.approx(14 / 3)


def test_scores(spark):
    row = {"position": "mid", "kills": "10", "deaths": "0", "assists": "4", "teamkills": "20", "totalcs": "300", "damageshare": "0.31", "result": "1", "gamelength": "1500", "golddiff14": "1500", "csat15": "160", "cspm": "x"}
    got = one(scoring.fantasy_points(spark.createDataFrame([row])))
    # 15 + 4 + 3 base; 2 kp, 3 kills, 3 damage, 1 win, 2 fast win, 3 deathless; 1.5 gold; 3 + 1.5 mid
    assert got["fantasy_pts"] == pytest.approx(42.0)


def test_score_sources_fall_back_by_whole_table(spark):
    df = spark.createDataFrame([("0", "5", "7")], "totalcs string, minionkills string, monsterkills string").withColumn("position", F.lit("top"))
    assert one(scoring.fantasy_points(df))["cs"] == 12


def test_numbers(spark):
    df = scoring.numbers(spark.createDataFrame([("3.5",), ("x",), (None,), ("NaN",)], "a string"), ["a", "b"])
    assert [tuple(r) for r in df.collect()] == [(3.5, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def team_rows(spark):
    def row(game, number, date, side, team, first, prefix):
        return (game, number, date, side, team, first, [f"{prefix}b{k}" for k in range(1, 6)], [f"{prefix}p{k}" for k in range(1, 6)])

    t = datetime.datetime(2024, 1, 1, 12)
    rows = [row("g1", 1, t, "Blue", "A", 0, "x"), row("g1", 1, t, "Red", "B", 1, "y"), row("g2", 2, t + datetime.timedelta(hours=1), "Blue", "B", 1, "z"), row("g2", 2, t + datetime.timedelta(hours=1), "Red", "A", 0, "w")]
    rows += [row("g3", 1, t + datetime.timedelta(hours=2), "Blue", "A", 1, "q"), row("g3", 1, t + datetime.timedelta(hours=2), "Red", "B", 0, "r"), row("g4", 2, t, "Blue", "A", 1, "s")]
    rows[2][6][0] = "xp1"  # a ban that repeats a pick of the series
    return spark.createDataFrame(rows, "gameid string, game int, date timestamp, side string, teamname string, firstPick int, bans array<string>, picks array<string>")


def test_draft_reconstruction(spark):
    games = sequences.series(sequences.canonical_games(team_rows(spark)))
    assert {r["gameid"]: (r["series_id"], r["complete"]) for r in games.collect()} == {"g1": ("g1", True), "g2": ("g1", True), "g3": ("g3", True)}
    actions = {(r["gameid"], r["action_number"]): r for r in sequences.draft_actions(games).collect()}
    assert len(actions) == 60
    assert actions["g1", 1]["side"] == "Red" and actions["g1", 7]["champion"] == "yp1" and actions["g1", 7]["action_type"] == "pick"
    assert len(actions["g2", 1]["pool"]) == 10 and not actions["g1", 1]["pool"] and not actions["g3", 1]["pool"]
    assert actions["g2", 1]["conflicts"] == "fearless_unavailable" and not actions["g2", 1]["chosen_was_legal"]
    assert actions["g1", 20]["picked_before"] and len(actions["g1", 20]["picked_before"]) == 9


def test_version_distances(spark):
    cases = [("15.1", "14.24", 2, 3.0), ("16.10", "16.7", 5, 5.0), ("16.10", "16.8", 5, 2.0), ("16.14", "16.12", 5, 2.0)]
    for target, old, reset, want in cases:
        assert spark.range(1).select(versions.distance(F.lit(target), F.lit(old), reset)).first()[0] == want


def test_pairs_and_boosts(spark):
    rows = [(g, i) for g in range(4) for i in ("a", "b")] + [(9, "a"), (10, "c")]
    df = spark.createDataFrame(rows, "g int, i string").withColumn("k", F.lit(1))
    got = one(versions.pair_boosts(df, ["k"], "g", "i"))
    assert (got["a"], got["b"], got["n"]) == ("a", "b", 4) and got["boost"] == pytest.approx(min(0.25, 4 / 4 * 4 / 12))


def test_price_path_resets_and_caps(spark):
    rows = [("u", 1, "s", 30.0), ("u", 2, "s", 13.0), ("u", 3, "t", 0.0)]
    got = folds.price_paths(spark.createDataFrame(rows, "e string, w int, p string, s double"), "e", "w", "p", "s").orderBy("week").collect()
    assert [(r["price"], r["next_price"], r["reset"]) for r in got] == [(15.0, 18.4, True), (18.4, 18.4, False), (15.0, 12.4, True)]


def test_price_steps_damp_rises_only(spark):
    steps = [spark.range(1).select(folds.price_step(F.lit(p), F.lit(s), folds.Market())).first()[0] for p, s in ((22.0, 23.0), (26.0, 23.0), (26.0, 3.0), (32.0, 99.0))]
    assert steps == [23.0, 26.5, 24.0, 32.0]


def test_elo(spark):
    rows = [(1, 1, "a", "b", 1.0), (1, 2, "a", "b", 0.0)]
    got = folds.elo(spark.createDataFrame(rows, "pool int, n int, side_a string, side_b string, a_win double"), "pool", ["n"]).orderBy("n").collect()
    assert (got[0]["rating_a"], got[0]["p_a"]) == (1500.0, 0.5)
    assert (got[1]["rating_a"], got[1]["rating_b"]) == (1516.0, 1484.0)
    assert folds.expected(1600, 1500) + folds.expected(1500, 1600) == pytest.approx(1)


def lineup_items(spark, rows):
    return spark.createDataFrame(rows, "slot string, item string, team string, cost double, points double, opponents array<string>")


def test_lineup_prefers_variety_and_keeps_budget(spark):
    rows = [(s, f"{s}-{t}", t, 10.0, 10.0, []) for s in "abcde" for t in (s.upper(), "Z")]
    best = one(lineup.optimize(lineup_items(spark, rows), list("abcde"), "slot", "team", "cost", "points", "item", 100.0, {5: 0.25}, 1))
    assert best["groups"] == 5 and best["total"] == 62.5
    dear = [(s, s, s, 21.0, 10.0, []) for s in "abcde"]
    assert lineup.optimize(lineup_items(spark, dear), list("abcde"), "slot", "team", "cost", "points", "item", 100.0, {}, 1).count() == 0


def test_lineup_conflicts(spark):
    rows = [("a", "p", "A", 1.0, 10.0, ["B"]), ("b", "q", "B", 1.0, 10.0, ["A"]), ("b", "r", "C", 1.0, 9.0, ["D"])]
    best = one(lineup.optimize(lineup_items(spark, rows), ["a", "b"], "slot", "team", "cost", "points", "item", 9.0, {}, 1, "opponents", 3.0))
    assert best["item1"] == "r" and best["rank_score"] == 19.0


def test_metrics(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)], "p double, y int")
    got = one(df.agg(*(c.alias(k) for k, c in models.metrics(F.col("p"), F.col("y")).items())))
    assert got["accuracy"] == 0.5 and got["brier"] == 0.25 and got["log_loss"] == pytest.approx(0.693147, abs=1e-6)


def test_naive_bayes_prefers_the_seen(spark):
    train = spark.createDataFrame([("A", "orianna"), ("A", "orianna"), ("B", "azir")], "team string, champion string")
    got = {r["champion"]: r["probability"] for r in models.naive_bayes(train, spark.createDataFrame([(1, "A")], "k int, team string"), ["team"], "champion", "k").collect()}
    assert got["orianna"] > got["azir"] and sum(got.values()) == pytest.approx(1)


def test_logistic_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=200), 1)
    y = (rng.random(200) < 1 / (1 + np.exp(-2 * x))).astype(int)
    got = models.logistic(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y int"), ["x"], "y", steps=5)
    w = np.zeros(2)
    features = np.stack([x, np.ones(200)], axis=1)
    for _ in range(5):
        w = w - 0.1 * (features.T @ (1 / (1 + np.exp(-features @ w)) - y) / 200 + np.array([0.01, 0]) * w)
    assert got == pytest.approx(w)


def test_registered_fits_take_all_steps(spark):
    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    rows = orders.select((F.col("o_orderstatus") == "F").cast("double"), (F.col("o_totalprice") / 250000 - 1).cast("double"), (F.year("o_orderdate") - 1998).cast("double")).toPandas().to_numpy()
    y, x = rows[:, 0], np.column_stack([rows[:, 1:], np.ones(len(rows))])
    w = np.zeros(3)
    for _ in range(200):
        w = w - 0.1 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + np.array([0.01, 0.01, 0]) * w)
    got = {r["feature"]: r["weight"] for r in registry.queries()["logit_fit"](spark, sf).collect()}
    assert [got[k] for k in ("price", "year", "intercept")] == pytest.approx(w.tolist(), abs=1e-6)

    own = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m")).toPandas()
    users = [(g["n"].to_numpy() / g["n"].sum(), g["m"].to_numpy() / 50) for _, g in own.sort_values(["user_id", "m", "event_type"], ascending=[True, False, True]).groupby("user_id")]
    w = np.array([2.5, 1.8])
    for _ in range(10):
        slope = np.zeros(2)
        for pair in users:
            z = np.exp(w @ np.array(pair))
            slope += np.array([c[0] - (z / z.sum()) @ c for c in pair])
        w = np.maximum(0.001, w + 0.05 * (slope / len(users) - 0.01 * w))
    got = {r["feature"]: r["weight"] for r in registry.queries()["conditional_logit"](spark, sf).collect()}
    assert [got[k] for k in ("share", "mean")] == pytest.approx(w.tolist(), abs=1e-6)


def test_context_flip_and_opponents(spark):
    rows = spark.createDataFrame([("g", "Blue", "A", 1), ("g", "Red", "B", 2), ("h", "Blue", "A", 3)], "g string, side string, team string, v int")
    flipped = context.attach_context(rows, rows, ["g", "side"], ["v"], "opp_", ("side", {"Blue": "Red", "Red": "Blue"}))
    assert {(r["g"], r["side"]): r["opp_v"] for r in flipped.collect()} == {("g", "Blue"): 2, ("g", "Red"): 1, ("h", "Blue"): None}
    assert {(r["g"], r["team"]): r["opponent"] for r in context.opponents(rows, "g", "team").collect()} == {("g", "A"): "B", ("g", "B"): "A", ("h", "A"): ""}


def test_novelty(spark):
    history = spark.createDataFrame([("mid", "p", "orianna"), ("mid", "q", "azir")], "role string, player string, champion string")
    wanted = spark.createDataFrame([("mid", "p", c) for c in ("orianna", "azir", "syndra")], "role string, player string, champion string")
    assert {r["champion"]: r["multiplier"] for r in ranking.novelty(wanted, history, "role", "player", "champion").collect()} == {"orianna": 1.3, "azir": 1.5, "syndra": 1.7}


def test_availability_and_labels(spark):
    got = spark.range(1).select(profiles.availability(F.lit(1.0), F.lit(0.0)), profiles.pool_label(F.lit(0.5), F.lit(9)), profiles.pool_label(F.lit(0.8), F.lit(9))).first()
    assert got[0] == pytest.approx(0.30) and tuple(got[1:]) == ("Wide", "Concentrated")


def test_text_functions(spark):
    df = spark.createDataFrame([("Split 2, Round 1", " Bob ")], "r string, n string")
    got = df.select(text.market_split("r", {"2": "Summer"}), text.opening_round("r"), text.player_key("n"), text.slug("r")).first()
    assert tuple(got) == ("Summer", True, "bob", "split-2-round-1")


def test_text_vectors_are_stable(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string").withColumn("v", vectors.text_vector(F.col("t"), 16))
    rows = df.select("t", vectors.dot(F.col("v"), F.col("v")).alias("n"), "v").collect()
    assert rows[0]["n"] == pytest.approx(1) and rows[0]["v"] != rows[1]["v"]


def test_market_flattening(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"round": {"id": "r", "name": "Round 1"}, "teams": [{"id": "1", "code": "AA", "name": "Team A"}, {"id": "2", "code": "BB", "name": "Team B"}], "roundPlayers": [{"id": "p", "summonerName": "Bob", "role": "mid", "teamId": "1", "price": 15.5, "previousPrice": 15.0, "opponentIds": ["2", "1"]}]}')
    raw = spark.read.schema(tables.MARKET).json(str(tmp_path / "m.json"), multiLine=True)
    first = tables.flatten_market(raw, "2026-01-01T00:00:00Z")
    got = one(first)
    assert (got["team_code"], got["opponent_codes"], got["price_change"]) == ("AA", "BB|AA", 0.5)
    later = tables.flatten_market(raw, "2026-01-02T00:00:00Z").withColumn("price", F.lit(20.0))
    assert [x["price"] for x in one(tables.price_history(first.unionByName(later)))["prices"]] == [20.0]
    tables.write_snapshot(first, str(tmp_path / "snap"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_snapshot(first, str(tmp_path / "snap"))


def test_match_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gameid,patch,league\ng1,15.10,LCK\n")
    (tmp_path / "b.csv").write_text("gameid,patch,league\ng2,15.1,LPL\n")
    rows = tables.read_matches(spark, f"{tmp_path}/*.csv").orderBy("gameid").collect()
    assert [r["patch"] for r in rows] == ["15.10", "15.1"]
    with pytest.raises(ValueError, match="missing columns: date"):
        tables.require_columns(tables.read_matches(spark, f"{tmp_path}/*.csv"), ["date"])
    assert tables.read_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0


def test_players_keep_their_source_league(spark):
    rows = [("LTA N", 2025, "Spring", "T", "jng")] * 18 + [("LCS", 2025, "Showmatch", "T", "mid"), ("EWC", 2025, "Main", "U", "mid"), ("LCS", 2025, "Spring", "few", "mid"), ("XX", 2025, "Spring", "T", "mid")]
    df = spark.createDataFrame(rows, "league string, year int, split string, teamname string, position string")
    got = tables.normalize_players(df, {"jng": "jgl", "mid": "mid"}, {"LTA N": "LCS"}, ["LCS"], ["EWC"])
    assert {(r["league"], r["source_league"], r["position"], r["teamname"]) for r in got.collect()} == {("LCS", "LTA N", "jgl", "T"), ("EWC", "EWC", "mid", "U")}


def test_streams_give_batch_rows(spark, tmp_path):
    t = datetime.datetime(2024, 1, 3)
    rows = [("a", t, 1.0), ("a", t + datetime.timedelta(hours=1), 2.0), ("a", t + datetime.timedelta(days=6), 4.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = windows.weekly(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", ["k"], "v")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("weekly").start()
    query.processAllAvailable()
    query.stop()
    batch = sorted(map(tuple, windows.weekly(df, "ts", ["k"], "v").collect()))
    assert sorted(map(tuple, spark.sql("select * from weekly").collect())) == batch
    assert [r[0] for r in batch] == [datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 8)]
    assert windows.sessions(df, "ts", ["k"]).count() == 2


def test_hot_counters_are_plain_counters(spark):
    rows = [(k, None if k % 11 == 0 else "ab"[k % 3 == 0], k // 7) for k in range(60)]
    df = spark.createDataFrame(rows, "n long, kind string, hour long")
    got = folds.counters(df, ["n"], {"plain": ["kind"]}, {"hot": ["kind"], "every": []}, F.col("hour")).collect()
    assert len(got) == 60 and all(r["hot"] == r["plain"] and r["every"] == r["n"] for r in got)


def test_lineups_of_markets_are_those_of_brute_force(spark):
    import itertools
    import random

    rng = random.Random(3)
    rows = [(m, s, "xyz"[rng.randrange(3)], float(rng.randrange(1, 6)), float(rng.randrange(1, 6)), 100 * m + 10 * n + j) for m in range(3) for n, s in enumerate("abc") for j in range(7) if (m, s) != (2, "b")]
    df = spark.createDataFrame(rows, "market int, slot string, team string, cost double, points double, item int")
    got = {(r["market"], r["rank"]): (r["item0"], r["item1"], r["item2"]) for r in lineup.optimize(df, list("abc"), "slot", "team", "cost", "points", "item", 9.0, {3: 0.25}, 4, market=["market"]).collect()}
    want = {}
    for m in range(3):
        found = []
        for three in itertools.product(*([r for r in rows if r[0] == m and r[1] == s] for s in "abc")):
            cost, base = sum(r[3] for r in three), sum(r[4] for r in three)
            if cost <= 9:
                found.append((-round(base * (1.25 if len({r[2] for r in three}) == 3 else 1.0), 2), -base, cost, tuple(r[5] for r in three)))
        want |= {(m, k): x[3] for k, x in enumerate(sorted(found)[:4], 1)}
    assert got == want and len(got) == 8


def test_teammates_count_without_the_player(spark):
    df = spark.createDataFrame([(1, "p", "x", 0.6), (1, "p", "y", 0.4), (1, "q", "y", 1.0), (2, "r", "x", 1.0)], "team int, player string, item string, chance double")
    boosts = spark.createDataFrame([("x", "y", 0.2)], "a string, b string, boost double")
    got = {(r["player"], r["item"]): (round(r["p"], 6), round(r["synergy"], 6)) for r in ranking.teammate_synergy(df, boosts, ["team"], "player", "item", "chance", rounds=1).collect()}
    assert got == {("p", "x"): (round(0.72 / 1.12, 6), 0.2), ("p", "y"): (round(0.4 / 1.12, 6), 0.0), ("q", "y"): (1.0, 0.12), ("r", "x"): (1.0, 0.0)}


def test_rows_too_far_from_the_anchor_are_an_error(spark):
    df = spark.createDataFrame([("a", k * 400 * asof.DAY, 1.0) for k in range(3)], "k string, t long, v double")
    assert asof.decayed_asof(df.where(F.col("t") <= 400 * asof.DAY), ["k"], "t", "v", 1.0, 1000, 0).where("rows > 0").first()["mean"] == 1
    with pytest.raises(Exception, match="half-lives from the anchor"):
        asof.decayed_asof(df, ["k"], "t", "v", 1.0, 1000, 0).collect()


def test_phases_are_named_by_split_month_and_playoffs(spark):
    rows = [("Spring", "2025-02-01", "0", "Spring"), (None, "2026-05-02", "1", "Spring Playoffs"), ("Regular", "2025-10-30", None, "Lock-In"), ("nan", "2024-07-01", "0", "Spring"), ("EWC Main", "2025-07-01", "1", "NA EWC Qualifiers Playoffs"), ("Summer Playoffs", "2025-08-01", "1", "Summer Playoffs"), (" ", None, " 1 ", "Spring Playoffs")]
    df = spark.createDataFrame(rows, "split string, date string, playoffs string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", scoring.build_phase("split", "date", "playoffs").alias("got")).collect())


def test_comfort_that_is_often_banned_is_left(spark):
    def row(player, item, category, bonus, ban):
        return player, item, category, bonus, 0.1, 0.0, 0.0, ban

    comfort, league, wild = "already_played_by_player", "unplayed_by_player", "unplayed_in_role"
    rows = [row("a", "x", comfort, 2.0, 0.3), row("a", "y", league, 1.0, 0.0), row("a", "z", wild, 3.0, 0.0), row("a", "w", wild, 2.0, 0.0), row("b", "x", comfort, 2.0, 0.25), row("b", "y", league, 9.0, 0.0), row("c", "x", comfort, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "player string, item string, novelty_category string, expected_bonus double, pick_probability double, player_share double, leading_share double, ban_rate double")
    got = {(r["player"], r["item"]): r for r in ranking.tiered_portfolio(df, ["player"], "item").collect()}
    assert len(got) == 7 and [k for k, r in got.items() if r["risk_pivot_recommended"]] == [("a", "z")]
    assert {r["risk_pivot_from"] for k, r in got.items() if k[0] == "a"} == {"x"} and got["a", "y"]["recommended_tier"] == "1.7x_novelty_wildcard"
    assert got["b", "y"]["portfolio_strategy"] == got["c", "x"]["portfolio_strategy"] == "best_expected_value_within_tier" and got["a", "w"]["portfolio_rank"] == 2


def test_two_rows_of_context_are_an_error(spark):
    rows = spark.createDataFrame([("g", "Blue"), ("h", "Red"), (None, "Red")], "g string, side string")
    more = spark.createDataFrame([("g", "Blue", 1, ["x"]), ("h", "Red", 2, ["y"]), ("h", "Red", 3, ["z"]), (None, "Red", 4, []), (None, "Red", 5, [])], "g string, side string, v int, items array<string>")
    got = context.attach_context(rows, more.where("v <> 3"), ["g", "side"], ["v", "items"], "team_").collect()
    assert {(r["g"], r["team_v"], tuple(r["team_items"] or [])) for r in got} == {("g", 1, ("x",)), ("h", 2, ("y",)), (None, None, ())}
    with pytest.raises(Exception, match="more than one row of context"):
        context.attach_context(rows, more, ["g", "side"], ["v", "items"], "team_").collect()
