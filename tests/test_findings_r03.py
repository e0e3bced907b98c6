"""What the review of round 3 found, on tables small enough to read."""

import duckdb
import pytest
from pyspark.sql import functions as F

from driftline.functions.numbers import half_even, ordered_mean
from driftline.plans import registry

SF = "/root/testdata/sf0.1"


def compared(spark, name, sf_dir, *tables):
    """(rows of a query, rows of its SQL) over the Parquet tables of a folder, floats as they are."""
    db = duckdb.connect()
    for t in tables:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = db.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = registry.queries()[name](spark, str(sf_dir)).select(*columns).collect()
    return sorted(map(str, map(tuple, got))), sorted(map(str, want.fetchall()))


def part_of_events(path, where):
    duckdb.execute(f"copy (select * from '{SF}/events.parquet' where {where} order by event_id) to '{path}/events.parquet' (format parquet)")
    return path


def test_half_even_is_round_even(spark):
    values = [15.549999999999999, 15.55, 8.45, -8.45, 44.0361875, 30.945, 1.005, 0.0]
    for digits in (1, 2, 3, 6):
        want = [duckdb.execute(f"select round_even(?::double, {digits})", [v]).fetchone()[0] for v in values]
        got = spark.createDataFrame([(v,) for v in values], "v double").select(half_even("v", digits).alias("r")).collect()
        assert [r["r"] for r in got] == want
    assert spark.range(1).select(half_even(F.lit(None).cast("double"), 2).alias("r")).first()["r"] is None


def test_mean_is_added_in_order(spark):
    rows = [(n, v) for n, v in enumerate([145.11, 44.94, 147.65, 192.51, 199.79])] + [(9, None)]
    for dealt in (rows, rows[::-1]):
        assert spark.createDataFrame(dealt, "n int, v double").repartition(3).agg(ordered_mean("v", "n").alias("m")).first()["m"] == 146.0
    assert spark.createDataFrame([(1, None)], "n int, v double").agg(ordered_mean("v", "n").alias("m")).first()["m"] is None


@pytest.mark.parametrize("name", ["price_path", "official_prices", "path_metrics"])
def test_price_paths_at_ties(spark, tmp_path, name):
    got, want = compared(spark, name, part_of_events(tmp_path, "user_id IN (884, 1394) AND (event_type <> 'signup' OR ts < TIMESTAMP '2024-01-29')"), "events")
    assert got == want


def test_week_projection_whatever_the_order_of_the_file(spark, tmp_path):
    values = "(VALUES (1, 145.11), (4, 44.94), (7, 147.65), (10, 192.51), (13, 199.79)) v(event_id, value)"
    rows = f"select event_id::bigint as event_id, timestamp '2024-01-02' + interval (event_id) minute as ts, 5::bigint as user_id, 'view' as event_type, value::double as value, '' as props from {values}"
    for order in ("event_id", "event_id desc"):
        duckdb.execute(f"copy ({rows} order by {order}) to '{tmp_path}/events.parquet' (format parquet)")
        got = registry.queries()["week_projection"](spark, str(tmp_path)).first()
        assert (got["projection"], got["n"], got["scheduled_matchups"]) == (146.0, 5, 1)


def test_profile_means_at_ties(spark):
    """The mean of these is 1 bit beside a tie of the sixth digit: SQL scales it onto the tie, its shortest text is none."""
    from driftline.operators import labs

    values = [67.96, 139.13, 173.9, 131.22, 183.26, 109.39, 196.56, 2.59, 67.54, 32.4, 194.82, 5.4, 56.87, 35.62, 27.39, 55.4, 37.62, 77.42, 37.69, 58.49, 182.13, 27.08, 84.76, 141.55, 82.12, 45.51, 30.44, 151.88, 56.62, 109.24, 107.63, 176.86]
    rows = [(n, "p", 1, "c", 1.0, v, "t", n, "1") for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, "n int, player string, game int, champion string, win double, value double, team string, day int, patch string")
    want = duckdb.execute("select round_even(avg(v), 6) from (select unnest(?::double[]) as v)", [values]).fetchone()[0]
    for dealt in (df.coalesce(1), df.repartition(7)):
        used = labs.usage(dealt, ["player"], "champion", "game", "win", {"value": 6}, "team", "day", "patch", ["n"]).collect()
        assert [r["avg_value"] for r in used] == [want, want]


def test_market_documents_do_not_grow_with_the_tables(spark, tmp_path):
    """A nation of 12,000 customers and 9,000 suppliers has three documents, of the teams that their players need."""
    from driftline.plans.records import market

    duckdb.execute(f"copy (select i as c_custkey, 'c' || i as c_name, 1 as c_nationkey, i / 7.0::double as c_acctbal, 'mid' as c_mktsegment from range(12000) r(i)) to '{tmp_path}/customer.parquet' (format parquet)")
    duckdb.execute(f"copy (select i as s_suppkey, 's' || i as s_name, 1 as s_nationkey, 0.0::double as s_acctbal from range(9000) r(i)) to '{tmp_path}/supplier.parquet' (format parquet)")
    sizes = market(spark, str(tmp_path)).select(F.size("roundPlayers").alias("p"), F.size("teams").alias("t")).collect()
    assert sorted(r["p"] for r in sizes) == [2000, 5000, 5000] and all(r["t"] <= r["p"] + 1 for r in sizes)
    got, want = compared(spark, "flatten_market", tmp_path, "customer", "supplier")
    assert got == want


def test_board_items_are_opened_after_all_joins(spark):
    """What meets priors is an action, not its every legal item."""
    from driftline.plans.drafts import board_features

    plan = board_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")


def test_markets_without_every_slot_leave_before_anything_is_ordered(spark):
    """Only whole markets are stored, once, and all halves come from there."""
    from driftline.operators import lineup

    rows = [(m, s, 10 * n + j, "AB"[j], 1.0, float(j)) for m in range(4) for n, s in enumerate("xyz") for j in range(2) if m or s != "z"] + [(5, "w", 1, "A", 1.0, 1.0)]
    items = spark.createDataFrame(rows, "market int, slot string, item int, team string, cost double, value double")
    assert {r["market"] for r in lineup.complete(items, ["market"], list("xyz"), "slot").collect()} == {1, 2, 3}
    kept = []
    best = lineup.optimize(items, list("xyz"), "slot", "team", "cost", "value", "item", 9.0, {}, 1, market=["market"], store=lambda x: kept.append(x) or x)
    assert {r["market"]: (r["item0"], r["item1"], r["item2"]) for r in best.collect()} == {m: (1, 11, 21) for m in (1, 2, 3)}
    assert [x.count() for x in kept] == [3]


def test_candidates_are_shuffled_once_and_not_once_a_trial(spark):
    """Trials are tried on a target's candidates where these have come together."""
    from driftline.plans.strategies import simplex_search

    plan = simplex_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("collect_list")


def test_lines_are_counted_before_they_meet_their_context(spark):
    from driftline.plans.contexts import own_context

    plan = own_context(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Aggregate")


def test_games_of_pairs_are_read_once(spark):
    """An item's games come from the same pass as its pairs; a game without a name is one for pairs only."""
    from driftline.operators import versions

    rows = [(1, g, i) for g in range(4) for i in "ab"] + [(1, 9, "a"), (None, 1, "a"), (None, 1, "b"), (1, None, "a"), (1, None, "b"), (1, 0, None)]
    df = spark.createDataFrame(rows, "year int, game int, item string")
    found = versions.pair_boosts(df, ["year"], "game", "item")
    assert [tuple(r) for r in found.collect()] == [(1, "a", "b", 5, 0.25)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_open_roles_make_a_candidate_one_row(spark):
    from driftline.operators import drafts

    states = spark.createDataFrame([(1, ["x"]), (2, [])], "game int, enemies array<string>")
    roles = spark.createDataFrame([("x", "top", 0.75), ("x", "mid", 0.25), ("y", "top", 1.0), ("z", None, 0.5)], "item string, role string, p double")
    wanted = spark.createDataFrame([(g, i) for g in (1, 2) for i in ("x", "y", "z", "new")], "game int, item string")
    found = drafts.role_open(states, wanted, roles, ["game"], "enemies", "item")
    assert {(r["game"], r["item"]): r["open"] for r in found.collect()} == {(1, "x"): 0.375, (1, "y"): 0.25, (1, "z"): 0.5, (1, "new"): 1.0, **{(2, i): 1.0 for i in ("x", "y", "z", "new")}}
    # no join by role: it would make a row for every role of every candidate
    assert "role#" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)


def test_stream_keys_share_states(spark, tmp_path):
    """The keys of one hash are one state and one call, and each keeps its own pool and first item."""
    from driftline.streaming import pools

    rows = [(n, f"k{n % 9}", (n + 24) * 3_600_000_000, "abc"[n % 4 % 3]) for n in range(90)]
    df = spark.createDataFrame(rows, "row long, key string, us long, item string").withColumn("ts", F.timestamp_micros("us")).drop("us")
    for low in (0, 45):
        df.where((F.col("row") >= low) & (F.col("row") < low + 45)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["row"]: (r["key"], r["first_item"], r["pool"]) for r in pools.drained(pools.running_pools(stream, "key", "row", "ts", "item", "1 hour", groups=2), str(tmp_path / "out")).collect()}
    before = {n: [r[3] for r in rows[:n] if r[1] == k] for n, k, *_ in rows}
    assert got == {n: (k, (before[n] or [item])[0], sorted(set(before[n]))) for n, k, _, item in rows[:88]}
    assert spark.read.format("statestore").load(str(tmp_path / "out" / "checkpoint")).count() <= 2


def test_bayes_targets_stay_one_row(spark):
    """All labels of a target are one list: no row for each of its labels and features, and the plain chances and ranks."""
    from math import log

    from driftline.operators import models

    train = [("a", "x", "p"), ("a", "x", "q"), ("b", "y", "p"), ("b", "x", None), ("c", "y", "q"), (None, "z", "q")]
    targets = [(1, "x", "p", "a"), (2, "new", None, "b"), (3, None, "q", "never")]
    df = spark.createDataFrame(targets, "k int, f string, g string, own string")
    found = models.label_chances(spark.createDataFrame(train, "label string, f string, g string"), df, ["f", "g"], "label")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "explode" not in plan
    ranked = found.select("k", "chances", models.ranked_list("chances", lambda x: x != "b").alias("ranked")).collect()
    known = [t for t in train if t[0]]
    for k, f, g, _ in targets:
        logs = {}
        for c in "abc":
            mine = [t for t in known if t[0] == c]
            logs[c] = log((len(mine) + 1) / (len(known) + 3))
            for at, v in ((1, f), (2, g)):
                values = {t[at] for t in known} - {None}
                logs[c] += log((sum(t[at] == v and v is not None for t in mine) + 1) / (len(mine) + len(values) + (v not in values)))
        odds = {c: 2.718281828459045**x for c, x in logs.items()}
        row = next(r for r in ranked if r["k"] == k)
        assert {c["label"]: c["probability"] for c in row["chances"]} == pytest.approx({c: x / sum(odds.values()) for c, x in odds.items()})
        want = sorted("ac", key=lambda c: (-round(odds[c], 9), c))
        assert [(c["label"], c["rank"]) for c in row["ranked"]] == [(c, n + 1) for n, c in enumerate(want)]
        assert sum(c["probability"] for c in row["ranked"]) == pytest.approx(1.0)


def test_ratings_are_folded_once(spark, monkeypatch):
    """Scales, the fit and the report read stored matches and not the fold over all of them."""
    from driftline.operators import winmodel
    from driftline.plans import models as plans

    class Seen(Exception):
        pass

    def fit(training):
        raise Seen(training._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(winmodel, "fit", fit)
    with pytest.raises(Seen) as seen:
        plans.win_models(spark, "/root/testdata/sf0.001")
    assert "MapInPandas" not in str(seen.value) and "Join" not in str(seen.value)


def test_steps_of_fits_plan_no_queries(spark, monkeypatch):
    """Cached blocks are read by each step as they are; many tasks and one give the weights of a plain fit."""
    import numpy as np
    from pyspark.sql import DataFrame

    from driftline.operators import models

    rows = [(float(n % 7), float(n % 5) - 2, float(n % 3), float(n % 2), float(n % 11 > 4)) for n in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, z double").repartition(4)
    fits = {"one": (["a", "b"], "y"), "two": (["a", "b"], "z"), "three": (["c", "a"], "y"), "none": ([], "z")}
    many = models.logistic_many(df, fits, 30, task_rows=20)
    single = models.logistic_many(df, fits, 30)
    x = np.array(rows)
    for name, (features, label) in fits.items():
        own, y, w = x[:, ["abcyz".index(c) for c in features]], x[:, "abcyz".index(label)], np.zeros(len(features) + 1)
        for _ in range(30):
            error = 1 / (1 + np.exp(-(w[0] + own @ w[1:]))) - y
            w = w - 0.08 * np.append(error.mean(), own.T @ error / len(y) + 0.01 * w[1:])
        assert many[name] == pytest.approx(w) and single[name] == pytest.approx(w)
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("a step planned a query"))
    models.logistic_many(df, fits, 2, task_rows=20)


def test_sampled_rows_alone_ask_and_meet_their_role(spark, monkeypatch):
    """Rows outside the sample do not ask for totals, and only a role's rows are weighed for a target."""
    from driftline.operators import compare
    from driftline.plans.asof import engine_equivalence

    plans, differences = {}, compare.differences

    def seen(left, right, *rest):
        plans.update({n: x._jdf.queryExecution().optimizedPlan().toString() for n, x in (("fast", left), ("plain", right))})
        return differences(left, right, *rest)

    monkeypatch.setattr(compare, "differences", seen)
    found = engine_equivalence(spark, "/root/testdata/sf0.001").collect()
    assert {(r["column"], r["met"], r["beyond"]) for r in found} == {(c, 300, 0) for c in ("baseline", "recent", "projection")}
    assert "isnotnull(_sampled" in plans["fast"]
    assert any("Join Inner" in x and "(_role#" in x for x in plans["plain"].split("\n"))


@pytest.mark.parametrize("name", ["opponent_rates", "ban_events"])
def test_counts_of_actions_read_them_stored(spark, monkeypatch, name):
    """Games are rebuilt once and not for every count of their actions."""
    from driftline.operators import banstudy, profiles
    from driftline.plans import drafts as plans

    class Seen(Exception):
        pass

    def seen(actions, *rest, **named):
        raise Seen(actions._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(profiles, "draft_rates_before", seen)
    monkeypatch.setattr(banstudy, "ban_events", seen)
    with pytest.raises(Seen) as plan:
        plans.plans.queries[name](spark, "/root/testdata/sf0.001")
    assert "Window" not in str(plan.value) and "Aggregate" not in str(plan.value)
