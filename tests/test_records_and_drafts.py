"""Sources, draft features, rolling rankings and searches against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import text
from driftline.operators import asof, drafts, lineup, rolling, search, versions
from driftline.sources import tables


def test_malformed_lines_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4,5\n6\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    got = tables.malformed_lines(spark, str(tmp_path)).collect()
    assert [(r["file"].rsplit("/", 1)[1], r["lines"]) for r in got] == [("a.csv", 2)]


def test_team_and_player_rows(spark):
    names = [*tables.TEAM_COLUMNS, "position", "playername", "champion", "extra"]
    row = {n: "v" for n in names} | {"league": "LCS", "ban1": None, "pick1": " A "}
    rows = spark.createDataFrame([row | {"position": p, "champion": c} for p, c in (("team", None), ("mid", "A"), ("mid", " "), ("coach", "B"))] + [row | {"position": "team", "league": "X"}], ", ".join(f"`{n}` string" for n in names))
    team = tables.team_drafts(rows, ["LCS"]).collect()
    assert len(team) == 1 and team[0]["bans"] == ["", "v", "v", "v", "v"] and team[0]["picks"][0] == "A" and "extra" not in team[0].asDict()
    assert [r["champion"] for r in tables.player_rows(rows, ["LCS"], ["champion"]).collect()] == ["A"]
    with pytest.raises(ValueError, match="ban1"):
        tables.team_drafts(rows.drop("ban1"), ["LCS"])


def test_tables_on_disk(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached_table(spark, str(tmp_path / "cache"), {"rate": 0.3}, build).count() == 3
    assert tables.cached_table(spark, str(tmp_path / "cache"), {"rate": 0.15}, build).count() == 3 and len(calls) == 2
    for name, n in (("2026-01-01", 2), ("2026-02-01", 5)):
        spark.range(n).write.parquet(str(tmp_path / "shots" / name))
    assert tables.latest_snapshot(spark, str(tmp_path / "shots")).count() == 5
    path = str(tmp_path / "learn")
    assert tables.load_learnings(spark, path).count() == 0
    for severity, snippet, at in ((1.0, "a", "2026-01-01"), (3.0, "b", "2026-01-03"), (2.0, "a", "2026-01-02")):
        tables.append_rows(spark.createDataFrame([("c", severity, snippet)], "category string, severity double, snippet string").withColumn("at", F.lit(at).cast("timestamp")), path)
    (got,) = tables.load_learnings(spark, path).collect()
    assert got["severity"] == 3.0 and got["snippets"] == ["a", "b"]
    spark.createDataFrame([(1, "t", "A", 1), (1, "t", "B", 2)], "gameid int, team string, champion string, action_number int").write.parquet(str(tmp_path / "db" / "draft_actions"))
    spark.createDataFrame([(1, "t", "A", "mid", "P")], "gameid int, team string, champion string, role string, player string").write.parquet(str(tmp_path / "db" / "players"))
    got = tables.read_model_rows(spark, str(tmp_path / "db"), ["action_number", "player"]).orderBy("action_number").collect()
    assert [r["player"] for r in got] == ["P", None]


def test_small_functions(spark):
    df = spark.createDataFrame([("2026", "Split 2 Round 1", "Blue", " A ", "A", None, "LCS", 2020), ("2025", "Split 2 Round 1", "Red", "B", "", "C", "LEC", 2020), ("2026", " ", None, "", "", "", "LCS", 2019)], "y string, r string, s string, a string, b string, c string, l string, n int")
    got = df.select(text.dashboard_split("y", "r"), text.side_value(F.col("s"), F.lit("b"), F.lit("r")), text.pick_set("a", "b", "c"), text.in_period(F.col("l"), F.col("n"), ["LCS"], 2020, 2025), text.slug("r")).collect()
    assert [tuple(r) for r in got] == [("Spring", "b", ["A"], True, "split-2-round-1"), ("Split 2 Round 1", "r", ["B", "C"], False, "split-2-round-1"), ("Official Market", None, [], False, "unknown-round")]


def test_boost_of_nearby_versions_and_seasons(spark):
    boosts = spark.createDataFrame([("A", "B", "15.1", 0.2), ("A", "B", "15.3", 0.1), ("A", "B", "15.9", 0.25), ("A", "B", "14.5", 0.25)], "a string, b string, version string, boost double")
    seasons = spark.createDataFrame([("A", "B", 13, 0.04), ("A", "B", 12, 0.05)], "a string, b string, major int, boost double")
    wanted = spark.createDataFrame([("A", "B", t) for t in ("15.4", "16.1", "11.1")] + [("A", "C", "15.4")], "a string, b string, target string")
    got = {(r["b"], r["target"]): r["boost"] for r in versions.boost_lookup(wanted, boosts, seasons).collect()}
    assert got["B", "15.4"] == pytest.approx((0.2 * math.exp(-0.15 * 3) + 0.1 * math.exp(-0.15)) / 2)
    assert got["B", "16.1"] == pytest.approx(0.04 * 0.25) and got["B", "11.1"] == 0 and got["C", "15.4"] == 0


def test_open_roles_and_gate(spark):
    roles = spark.createDataFrame([("X", "mid", 0.6), ("X", "top", 0.4), ("E", "mid", 0.9), ("F", "mid", 0.5)], "champion string, role string, p double")
    states = spark.createDataFrame([(1, ["E", "F", "F"]), (2, []), (3, ["Z"])], "k int, enemies array<string>")
    wanted = spark.createDataFrame([(k, c) for k in (1, 2, 3) for c in ("X", "Y", "E")], "k int, champion string")
    got = {(r["k"], r["champion"]): r["open"] for r in drafts.role_open(states, wanted, roles, ["k"], "enemies", "champion").collect()}
    assert got[1, "X"] == pytest.approx(0.6 * 0.1 * 0.5 + 0.4) and got[1, "E"] == pytest.approx(0.05) and got[1, "Y"] == 1 and got[2, "E"] == 1 and got[3, "X"] == pytest.approx(1.0)
    meta = spark.createDataFrame([("L", "1", "A", 0.4), ("L", "1", "B", 0.1)], "league string, patch string, champion string, prior double")
    pairs = spark.createDataFrame([("L", "1", "A", "B"), ("L", "1", "A", "C"), ("L", "2", "A", "B")], "league string, patch string, c string, a string")
    gate = {(r["patch"], r["a"]): r["gate"] for r in drafts.meta_gate(pairs, meta, ["league", "patch"], "champion", "c", "a").collect()}
    assert gate == pytest.approx({("1", "B"): 0.5, ("1", "C"): 0.0, ("2", "B"): 1.0})


def test_board_fit_matches_numpy(spark):
    rng = np.random.default_rng(2)
    rows, groups = [], []
    for k in range(40):
        x = np.round(rng.random((6, 5)), 3)
        y = int(rng.integers(6))
        groups.append((x, y))
        rows += [(k, "pick", f"i{j}", j == y, *map(float, x[j])) for j in range(6)]
    rows.append((99, "pick", "alone", True, 9.0, 9.0, 9.0, 9.0, 9.0))
    df = spark.createDataFrame(rows, "action_id int, action_type string, item string, chosen boolean, meta double, comfort double, target double, counter double, phase double")
    w = np.array(drafts.BOARD_START)
    for _ in range(3):
        gradient = np.zeros(5)
        for x, y in groups:
            p = np.exp(x @ w - (x @ w).max())
            p /= p.sum()
            p[y] -= 1
            gradient += x.T @ p
        w = np.maximum(0.001, w - 0.05 * (gradient / len(groups) + 0.01 * w))
    got = drafts.fit_board(df, steps=3)
    assert got == pytest.approx(w, abs=1e-9)
    ranked = drafts.score_board(df, w).where("action_id = 0").orderBy("rank").collect()
    p = np.exp(groups[0][0] @ w)
    assert [r["probability"] for r in ranked] == pytest.approx(sorted(p / p.sum(), reverse=True))


def test_assignment_rejects_two_players(spark):
    actions = spark.createDataFrame([(1, "A")], "gameid int, champion string")
    players = spark.createDataFrame([(1, "A", "p"), (1, "A", "q")], "gameid int, champion string, player string")
    with pytest.raises(Exception, match="more than one player"):
        drafts.assign_players(actions, players, ["gameid", "champion"], ["player"]).collect()


def test_rolling_scores_match_plain_sums(spark):
    rng = np.random.default_rng(5)
    day = asof.DAY
    history = [(int(rng.integers(2)), int(rng.integers(4)), f"c{rng.integers(5)}", f"v{rng.integers(3)}", int(rng.integers(0, 40)) * day) for _ in range(300)]
    targets = [(k, k % 2, int(rng.integers(4)), f"v{rng.integers(4)}", int(rng.integers(0, 45)) * day) for k in range(20)]
    frame = spark.createDataFrame(history, "role int, player int, item string, version string, us long")
    wanted = spark.createDataFrame(targets, "key int, role int, player int, version string, us long")
    got = {(r["key"], r["item"]): r["score"] for r in rolling.rolling_scores(frame, wanted, "key", "role", "player", "item", "version", "us", 0.7, 0.15, 0, 9, 12).collect()}
    want = {}
    for key, role, player, version, at in targets:
        prior = [h for h in history if h[0] == role and at - 12 * day <= h[4] < at]
        meta, own = {}, {}
        for _, p, item, v, t in prior:
            w = 0.5 ** ((at - t) / day / 9)
            meta[item] = meta.get(item, 0) + w * (1 if v == version else 0.15)
            if p == player:
                own[item] = own.get(item, 0) + w
        for item in meta:
            want[key, item] = 0.7 * meta[item] / sum(meta.values()) + (0.3 * own.get(item, 0) / sum(own.values()) if own else 0)
    assert got == pytest.approx(want)


def test_trials_lie_on_the_simplex():
    trials = search.simplex_trials(30, 5)
    assert len(trials) == 31 and trials == search.simplex_trials(30, 5) and all(sum(t[1:]) == pytest.approx(1) for t in trials)
    grown = search.maturity_trials(5000, 5)
    assert grown == search.maturity_trials(5000, 5) and [t[0] for t in grown] == list(range(5001)) and {t[7] for t in grown} == set(search.HORIZONS)
    assert all(t[1] >= t[4] and t[2] <= t[5] and t[3] >= t[6] and sum(t[1:4]) == pytest.approx(1) == sum(t[4:7]) for t in grown)
    # uniform on the triangle: each part has mean 1/3 and exceeds x with chance (1 - x)^2
    parts = search.simplex(np.random.default_rng(1), 20_000)
    assert parts.mean(axis=0) == pytest.approx([1 / 3] * 3, abs=0.01) and (parts > 0.5).mean(axis=0) == pytest.approx([0.25] * 3, abs=0.02)
    assert search.comfort_grid([0.25, 0.5], [0.0, 0.5], [20.0]) == [(0.0, 0.0, 40.0), (0.25, 0.0, 20.0), (0.5, 0.0, 20.0), (0.5, 0.5, 20.0)]


def test_hot_frame_sums_match_plain_sums(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(rng.integers(2)), int(rng.integers(0, 400)) * asof.DAY // 10, float(rng.integers(9))) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, k int, us long, v double")
    got = {r["id"]: r["total"] for r in asof.hot_frame_sums(df, "id", ["k"], "us", {"total": F.col("v")}, 7).collect()}
    assert got == pytest.approx({i: sum(v for _, k2, t2, v in rows if k2 == k and t - 7 * asof.DAY <= t2 < t) for i, k, t, _ in rows})


def test_conflicts_count_the_lesser_slot_weight(spark):
    items = spark.createDataFrame([("TOP", "a", "t1", 1.0, 10.0, ["t2"]), ("MID", "b", "t2", 1.0, 10.0, ["t1", "t9"])], "slot string, item string, team string, cost double, value double, opponents array<string>")
    got = lineup.optimize(items, ["TOP", "MID"], "slot", "team", "cost", "value", "item", 10, {}, 1, "opponents", 4.0, slot_weights={"TOP": 0.5}).first()
    assert got["total"] == 20.0 and got["rank_score"] == 18.0


def test_files_of_different_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gameid,patch,league\ng1,15.10,LCK\ng2,15.1,LCK,more\n")
    (tmp_path / "b.csv").write_text("gameid,league,patch,result\ng3,LPL,14.20,1\n")
    (tmp_path / "c[1].csv").write_text("league,gameid\nLEC,g4\n")
    (tmp_path / "d.csv").write_text("patch,gameid,league\n13.1,g5,LCS\n")
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.csv.gz").write_bytes(b"\x1f\x8b not a gzip file")
    (tmp_path / "g.csv").write_text("other,names\n1,2\n")
    rows = tables.read_matches(spark, str(tmp_path), required=("gameid",)).orderBy("gameid")
    assert set(rows.columns) == {"gameid", "patch", "league", "result", "_file", "_line"}
    got = [(r["gameid"], r["patch"], r["league"], r["result"], r["_file"].rsplit("/", 1)[1][:1]) for r in rows.collect()]
    assert got == [("g1", "15.10", "LCK", None, "a"), ("g3", "14.20", "LPL", "1", "b"), ("g4", None, "LEC", None, "c"), ("g5", "13.1", "LCS", None, "d")]
    bad = {r["file"].rsplit("/", 1)[1]: r["problem"] for r in tables.rejected_files(spark, str(tmp_path), ("gameid",)).collect()}
    assert set(bad) == {"e.csv", "f.csv.gz", "g.csv"} and bad["g.csv"] == "missing columns: gameid"
    assert [(r["file"].rsplit("/", 1)[1], r["lines"]) for r in tables.malformed_lines(spark, str(tmp_path)).collect()] == [("a.csv", 1)]
    typed = tables.read_matches(spark, str(tmp_path / "b.csv"), spark.createDataFrame([], "gameid string, result int, patch double").schema)
    assert dict(typed.dtypes)["result"] == "int" and typed.first()["patch"] == "14.20"
    with pytest.raises(ValueError, match="no readable CSV file"):
        tables.read_matches(spark, str(tmp_path / "e.csv"))


def test_internationals_of_primary_teams_come_home(spark):
    rows = [("LCS", 2026, "Spring", "Team L", "mid", "a"), ("MSI", 2026, "", "LY", "mid", "b"), ("EWC", 2026, "", " Sent ", "jng", "c"), ("FST", 2026, "", "G2", "top", "d"), ("EWC", 2026, "", "G2", " Top", "e"), ("LCS", 2026, "x", "New", "top", "f"), ("EWC", 2025, "", "Sent", "top", "g")]
    df = spark.createDataFrame(rows, "league string, year int, split string, teamname string, position string, player string")
    primary = spark.createDataFrame([("LCS", 2026, t) for t in ("Team L", "Sent", "LY")], "league string, year int, team string")
    roles = {"top": "top", "mid": "mid", "jng": "jgl"}
    got = tables.normalize_players(df, roles, {}, ["LCS"], ["MSI", "EWC", "FST"], primary, home={"EWC": ("LCS", "Qualifiers")})
    assert got.columns == [*df.columns, "source_league"]
    found = {r["player"]: (r["league"], r["source_league"], r["split"], r["position"]) for r in got.collect()}
    assert found == {"a": ("LCS", "LCS", "Spring", "mid"), "b": ("MSI", "MSI", "", "mid"), "c": ("LCS", "EWC", "Qualifiers", "jgl"), "d": ("FST", "FST", "", "top"), "e": ("EWC", "EWC", "", "top"), "g": ("EWC", "EWC", "", "top")}
