"""Fits, win models and the ban study against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import banstudy, models, winmodel


def plain_fit(x, y, steps, rate, ridge, clip, w):
    design = np.column_stack([np.ones(len(x)), x])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -clip, clip)))
        g = design.T @ (p - y) / max(1, len(y))
        g[1:] += ridge * w[1:]
        w = w - rate * g
    return w


@pytest.mark.parametrize("task_rows", [10_000, 60])
def test_many_fits_are_single_fits(spark, task_rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(250, 3))
    y, z = (x[:, 0] + rng.normal(size=250) > 0).astype(float), (x[:, 2] > 0.3).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, z, strict=True)], "a double, b double, c double, y double, z double").repartition(5)
    fits = {"one": (["a", "b"], "y"), "two": (["a", "b", "c"], "z"), "three": (["c"], "y")}
    got = models.logistic_many(df, fits, 30, 0.3, 0.02, 5.0, {"three": [0.5, -0.5]}, task_rows)
    assert got["one"] == pytest.approx(plain_fit(x[:, :2], y, 30, 0.3, 0.02, 5.0, np.zeros(3)))
    assert got["two"] == pytest.approx(plain_fit(x, z, 30, 0.3, 0.02, 5.0, np.zeros(4)))
    assert got["three"] == pytest.approx(plain_fit(x[:, 2:], y, 30, 0.3, 0.02, 5.0, np.array([0.5, -0.5])))
    empty = models.logistic_many(df.limit(0), fits, 3, task_rows=task_rows)
    assert all(not w.any() for w in empty.values())


def test_a_gate_needs_both_windows_and_both_metrics(spark):
    def report(rows):
        return spark.createDataFrame(rows, "window string, model string, log_loss double, brier double")

    good = [("c", "elo", 0.6, 0.2), ("c", "logistic", 0.5, 0.1), ("v", "elo", 0.6, 0.2), ("v", "logistic", 0.59, 0.19)]
    assert winmodel.gate(report(good), "c", "v").first().asDict() == {"confirmed": True, "validated": True, "accepted": True, "source": "logistic"}
    # a gap that rounding to four digits hides is none
    close = [*good[:3], ("v", "logistic", 0.59999, 0.1)]
    assert winmodel.gate(report(close), "c", "v").first().asDict() == {"confirmed": True, "validated": False, "accepted": False, "source": "elo"}
    assert winmodel.gate(report(good[:2]), "c", "v").first()["source"] == "elo"


def test_win_rates_know_earlier_matches_of_both_sides(spark):
    random.seed(6)
    rows = [(k, k // 3, *random.sample("wxyz", 2), float(random.random() < 0.5), 1500.0, 1500.0, 0.5) for k in range(80)]
    df = spark.createDataFrame(rows, "m int, day int, side_a string, side_b string, a_win double, rating_a double, rating_b double, p_a double")
    got = {r["m"]: r for r in winmodel.pregame(df, "m", ["day", "m"], 5).collect()}
    known = {}
    for m, _, a, b, win, *_ in rows:
        for side, team in (("a", a), ("b", b)):
            last = known.get(team, [])[-5:]
            assert got[m][f"win_rate_{side}"] == pytest.approx((sum(last) + 2.5) / (len(last) + 5))
        known.setdefault(a, []).append(win)
        known.setdefault(b, []).append(1 - win)
    assert winmodel.scales(df.withColumns({"elo_diff": F.lit(0.0), "win_rate_diff": F.lit(0.0)})) == winmodel.NO_SPREAD


def test_ban_events_and_outcomes(spark):
    random.seed(8)
    day, rows = 86_400_000_000, []
    for game in range(60):
        time = random.randint(0, 40) * day
        teams = random.sample(["t1", "t2", "t3"], 2)
        for number in range(1, 9):
            side = number % 2
            rows.append((game, game // 4, number, "ban" if number < 5 else "pick", "l" + teams[0][1], teams[side], teams[1 - side], random.choice("abcdefg"), time))
    df = spark.createDataFrame(rows, "gameid int, series int, number int, action_type string, league string, team string, opponent string, item string, time long").withColumn("key", F.col("gameid") * 10 + F.col("number"))
    bans = banstudy.ban_events(df, ["time", "gameid", "number"], F.floor(F.col("time") / (7 * day)))
    got = {r["key"]: r for r in banstudy.outcomes(bans, df, "time", "series", "key").collect()}
    league, hit, team, own, target, liked, met = (Counter() for _ in range(7))
    even, picks = 1 / len({r[7] for r in rows}), [r for r in rows if r[3] == "pick"]
    for r in sorted(rows, key=lambda r: (r[8], r[0], r[2])):
        game, series, number, kind, lg, t, o, item, time = r
        if kind == "pick":
            target[t] += 1
            liked[t, item] += 1
            continue
        meta = (hit[lg, item] + 2 * even) / (league[lg] + 2)
        rate = (own[t, item] + 2 * meta) / (team[t] + 2)
        comfort = (liked[o, item] + 2 * even) / (target[o] + 2)
        found = got[game * 10 + number]
        assert (found["meta_rate"], found["team_rate"], found["comfort"]) == pytest.approx((meta, rate, comfort))
        assert found["surprise"] == pytest.approx(-np.log(0.6 * meta + 0.25 * rate + 0.15 * comfort)) and found["previous_matchup_bans"] == met[t, o, item]
        later = [p for p in picks if p[5] == o and p[7] == item and time < p[8] <= time + 14 * day]
        assert (found["same_series"], found["next_series"], found["within_days"]) == (any(p[1] == series for p in later), any(p[1] != series for p in later), bool(later))
        for c, k in ((league, lg), (hit, (lg, item)), (team, t), (own, (t, item)), (met, (t, o, item))):
            c[k] += 1
    assert len(got) == 240
    report = spark.createDataFrame([("x", 0.1), ("y", 0.0000001)], "outcome string, delta_log_loss double")
    assert banstudy.decision(report).first().asDict() == {"consistently_improves": False, "production_weight": "zero"}
    assert banstudy.decision(report.where("outcome = 'x'")).first()["consistently_improves"]


def test_ranks_by_ranges_are_plain_ranks(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, 1.5, -3.0, 7.25, float(k)])) for k in range(300)]
    df = spark.createDataFrame(rows, "n int, key string, v double")
    for values in (1_000_000, 20):
        got = {r["n"]: r["rank"] for r in models.average_ranks(df, ["key"], "v", "rank", values).collect()}
        for n, key, v in rows:
            low = lambda x: (x is not None, x or 0.0)
            own = [low(x) for _, k, x in rows if k == key]
            assert got[n] == sum(x < low(v) for x in own) + (own.count(low(v)) + 1) / 2
    assert models.average_ranks(df.limit(0), ["key"], "v", "rank").count() == 0
    assert [r["rank"] for r in models.average_ranks(df.where("v = 1.5 AND key = 'a'").limit(3), ["key"], "v", "rank").collect()] == [2.0] * 3
