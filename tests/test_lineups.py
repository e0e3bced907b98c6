"""Line-ups by bounds against trying all of them."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import lineup

SLOTS, WEIGHTS, VARIETY = ["top", "mid", "bot", "coach"], {"top": 0.5}, {3: 0.1, 4: 0.25}


def best_of(rows, budget, k, penalty):
    """All line-ups of a market's rows, in rank order."""
    found = []
    for four in itertools.product(*([r for r in rows if r["slot"] == s] for s in SLOTS)):
        cost, base = sum(r["cost"] for r in four), sum(r["value"] for r in four)
        if cost > budget + 1e-9:
            continue
        groups = len({r["team"] for r in four})
        total = round(base * (1 + max((v for n, v in VARIETY.items() if groups >= n), default=0.0)), 2)
        conflict = sum(penalty * min(WEIGHTS.get(a["slot"], 1.0), WEIGHTS.get(b["slot"], 1.0)) for a, b in itertools.combinations(four, 2) if b["team"] in a["opponents"] or a["team"] in b["opponents"])
        found.append((-round(total - conflict, 2), -total, -round(base, 2), round(cost, 2), tuple(r["item"] for r in four)))
    return [x[4] for x in sorted(found)[:k]]


@pytest.mark.parametrize(("penalty", "k"), [(0.0, 3), (4.0, 3), (7.0, 500)])
def test_line_ups_by_bounds_are_those_of_all(spark, penalty, k):
    rng = random.Random(k)
    rows = [{"market": m, "slot": s, "item": 100 * n + j, "team": rng.choice("ABCDE"), "cost": float(rng.randrange(1, 9)), "value": float(rng.randrange(-4, 12)) / 2, "opponents": [rng.choice("ABCDE")]} for m in range(4) for n, s in enumerate(SLOTS) for j in range(6 if m else 2)]
    rows += [{"market": 9, "slot": s, "item": 1, "team": "A", "cost": 1.0, "value": 1.0, "opponents": []} for s in SLOTS[:3]]
    df = spark.createDataFrame(rows, "market int, slot string, item int, team string, cost double, value double, opponents array<string>")
    best = lineup.optimize(df, SLOTS, "slot", "team", "cost", "value", "item", 17.0, VARIETY, k, "opponents" if penalty else None, penalty, ["market"], WEIGHTS)
    got = {}
    for r in best.orderBy("market", "rank").collect():
        got.setdefault(r["market"], []).append(tuple(r[f"item{n}"] for n in range(4)))
    want = {m: best_of([r for r in rows if r["market"] == m], 17.0, k, penalty) for m in range(4)}
    assert got == {m: x for m, x in want.items() if x}


def test_pairs_of_halves_that_cannot_be_among_the_best_are_no_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(s, 100 * n + j, "ABCDEFG"[j % 7], float(rng.randrange(1, 30)), float(rng.randrange(1, 400)) / 10) for n, s in enumerate(SLOTS) for j in range(14)]
    df = spark.createDataFrame(rows, "slot string, item int, team string, cost double, value double")
    made, real = [], lineup._Rules.scored
    monkeypatch.setattr(lineup._Rules, "scored", lambda self, x: made.append(x) or real(self, x))
    assert lineup.optimize(df, SLOTS, "slot", "team", "cost", "value", "item", 50.0, VARIETY, 3).count() == 3
    every = sum(sum(r[3] for r in x) <= 50 for x in itertools.product(*([r for r in rows if r[0] == s] for s in SLOTS)))
    assert sum(x.count() for x in made) < every / 20


def test_what_rounding_hides_does_not_prune(spark):
    df = spark.createDataFrame([("s", 1.0, 5.002, "b"), ("s", 1.0, 5.001, "a"), ("s", 1.0, 4.9, "c"), ("s", 2.0, 5.002, "d")], "slot string, cost double, value double, item string")
    assert {r["item"] for r in lineup.pruned(df, ["slot"], "cost", "value", "item", 1).collect()} == {"a", "b"}


def test_bonus_is_that_of_the_first_option(spark):
    players = spark.createDataFrame([("Ann", "X"), ("bob", "Y"), ("Cy", "X")], "player string, team string")
    options = spark.createDataFrame([("ann", "x", 1, 0.5, "late"), ("ANN", "X", 1, 0.9, "best"), ("ann", "x", 0, 0.1, "first"), ("Bob", "Z", 1, 1.0, "other")], "player string, team string, rank int, bonus double, champion string")
    got = {r["player"]: (r["champion"], r["bonus"]) for r in lineup.with_bonus(players, options, ["player", "team"], "rank", "bonus", "champion").collect()}
    assert got == {"Ann": ("first", 0.1), "bob": ("", 0.0), "Cy": ("", 0.0)}


def test_documents_hold_all_of_a_market(spark):
    rows = [(1, s, n, "AB"[n % 2], 1.0, float(n), []) for n, s in enumerate(SLOTS)]
    items = spark.createDataFrame(rows, "market int, slot string, item int, team string, cost double, value double, opponents array<string>")
    best = lineup.optimize(items, SLOTS, "slot", "team", "cost", "value", "item", 9.0, VARIETY, 2, "opponents", 1.0, ["market"])
    options = spark.createDataFrame([(1, 0, "y", 2), (1, 0, "x", 1), (1, 3, "z", 1)], "market int, item int, champion string, place int")
    found = lineup.documents(best, SLOTS, items, ["market"], "slot", "item", ["team"], options, ["place"], F.struct("champion"))
    document = json.loads(found.first()["document"])
    assert document["schema_version"] == 1 and [x["rank"] for x in document["lineups"]] == [1]
    assert [x["slot"] for x in document["lineups"][0]["items"]] == SLOTS
    assert [[o["champion"] for o in x["options"]] for x in document["lineups"][0]["items"]] == [["x", "y"], [], [], ["z"]]
