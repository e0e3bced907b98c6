"""Walk-forward models and markets against plain versions."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftline.operators import asof, market, rolling, walkforward

DAY = asof.DAY


def test_weeks_start_on_mondays(spark):
    rows = [("2024-01-01 00:00:00", "2024-01-01"), ("2024-01-07 23:59:59", "2024-01-01"), ("2024-01-08 00:00:00", "2024-01-08"), ("1969-12-31 12:00:00", "1969-12-29")]
    df = spark.createDataFrame(rows, "t string, w string").withColumn("at", F.unix_micros(F.col("t").cast("timestamp")))
    assert all(r["got"] == r["w"] for r in df.select("w", F.date_format(F.timestamp_micros(walkforward.week_start(F.col("at"))), "yyyy-MM-dd").alias("got")).collect())


def plain_strength(picks, a, b, target, week):
    """Boosts counted anew from all picks before the week."""
    groups, singles = defaultdict(set), Counter()
    for version, group, item, time in picks:
        if time < week:
            groups[version, group].add(item)
    pairs, seasons, single_seasons = Counter(), Counter(), Counter()
    for (version, _), items in groups.items():
        major = int(version.split(".")[0])
        for x in items:
            singles[version, x] += 1
            single_seasons[major, x] += 1
        if a in items and b in items:
            pairs[version] += 1
            seasons[major] += 1
    boost = lambda n, g: min(0.25, n / g * n / (n + 8))
    tm, tn = map(int, target.split("."))
    near = []
    for version, n in pairs.items():
        vm, vn = map(int, version.split("."))
        if n >= 3 and vm == tm and vn <= tn and tn - vn <= 4:
            near.append(boost(n, min(singles[version, a], singles[version, b])) * math.exp(-0.15 * (tn - vn)))
    if near:
        return min(0.25, sum(near) / len(near))
    old = [m for m, n in seasons.items() if n >= 3 and m < tm]
    if not old:
        return 0.0
    last = max(old)
    return min(0.05, 0.2 * boost(seasons[last], min(single_seasons[last, a], single_seasons[last, b]))) * 0.5 ** max(0, tm - last - 1)


def test_pair_strength_knows_the_weeks_before_only(spark):
    random.seed(4)
    picks = []
    for g in range(300):
        version, time = f"{random.choice([13, 14, 15])}.{random.randint(1, 6)}", random.randint(0, 40) * DAY
        picks += [(version, f"g{g}", item, time) for item in random.sample("abcdef", 3)]
    df = spark.createDataFrame(picks, "version string, group string, champion string, time long")
    asked = [(a, b, target, week * 7 * DAY) for a, b in ("ab", "ac", "bf", "de") for target in ("14.3", "15.1", "15.6", "17.2") for week in range(0, 7)]
    wanted = spark.createDataFrame(asked, "a string, b string, target string, week long")
    got = {tuple(r)[:4]: r["boost"] for r in walkforward.pair_strength(df, "group", "champion", "time")(wanted).select("a", "b", "target", "week", "boost").collect()}
    assert set(got) == set(asked)
    for key, boost in got.items():
        assert boost == pytest.approx(plain_strength(picks, *key)), key
    assert len({round(v, 6) for v in got.values()}) > 20


def plain_projection(history, entity, role, opponent, cutoff, frame=730, half=180.0):
    prior = [h for h in history if cutoff - frame * DAY <= h["time"] < cutoff]

    def mean(rows):
        if not rows:
            return None, 0.0, None
        w = [0.5 ** ((cutoff - h["time"]) / DAY / half) for h in rows]
        m = sum(x * h["value"] for x, h in zip(w, rows, strict=True)) / sum(w)
        return m, sum(w), math.sqrt(sum(x * (h["value"] - m) ** 2 for x, h in zip(w, rows, strict=True)) / sum(w))

    pool = [h for h in prior if h["role"] == role and h["domestic"]] or [h for h in prior if h["role"] == role]
    base, _, spread = mean(pool)
    own_rows = [h for h in prior if h["role"] == role and h["entity"].lower() == entity.lower()]
    own, weight, own_spread = mean(own_rows)
    if base is None:
        base = sum(h["value"] for h in prior) / len(prior) if prior else 0.0
    own = base if own is None else own
    rel = weight / (weight + 5)
    shrunk = rel * own + (1 - rel) * base
    om, ow, _ = mean([h for h in pool if h["opponent"] == opponent])
    effect = ow / (ow + 15) * ((base if om is None else om) - base)
    hm, hw, _ = mean([h for h in own_rows if h["opponent"] == opponent])
    h2h = hw / (hw + 3) * (hm - shrunk) if hw > 0.5 else 0.0
    pm, pw, _ = mean([h for h in own_rows if h["playoff"]])
    boost = 0.2 * (pm / (own if own > 0 else 1) - 1) if pw > 1 else 0.0
    own_rows.sort(key=lambda h: (h["time"], h["row"]))
    short = [h["value"] for h in own_rows[-5:]]
    return {"projected": shrunk + 0.35 * effect + 0.25 * h2h + shrunk * boost, "recent": own, "baseline": base, "games": len(own_rows), "last5": sum(short) / len(short) if short else own, "last_game": own_rows[-1]["time"] if own_rows else None, "effective_games": weight}


def test_market_rows_need_not_be_in_the_history(spark):
    random.seed(9)
    history = [{"row": k, "entity": random.choice(["Ann", "bob", "Cy"]), "role": random.choice(["top", "mid"]), "opponent": random.choice("XYZ"), "time": random.randint(0, 900) * DAY + k, "value": round(random.uniform(0, 40), 2), "playoff": random.random() < 0.2, "domestic": random.random() < 0.6} for k in range(400)]
    df = spark.createDataFrame(history, "row long, entity string, role string, opponent string, time long, value double, playoff boolean, domestic boolean")
    scheduled = [(1, "ANN", "top", ["X"], 905 * DAY, "a"), (2, "bob", "top", ["Y", "Z"], 500 * DAY, "a"), (3, "Cy", "mid", [], 700 * DAY, "b"), (4, "nobody", "mid", ["X", "", "Q"], 905 * DAY, "b"), (5, "Ann", "jgl", ["X"], 905 * DAY, "b"), (6, "Ann", "top", None, -DAY, "b"), (7, "Ann", "top", ["X"], 5000 * DAY, "b")]
    rows = spark.createDataFrame(scheduled, "id long, entity string, role string, opponents array<string>, cutoff long, team string")
    got = {r["id"]: r for r in market.project(df, rows, 180, 730, 0, 9).collect()}
    assert set(got) == {r[0] for r in scheduled} and got[4]["scheduled_matchups"] == 2 and got[3]["scheduled_matchups"] == 0
    for number, entity, role, opponents, cutoff, _ in scheduled:
        each = [plain_projection(history, entity, role, o, cutoff) for o in [o for o in opponents or [] if o] or [""]]
        for name in ("projected", "recent", "baseline", "last5", "effective_games"):
            assert got[number][name] == pytest.approx(sum(x[name] for x in each) / len(each), abs=1e-6), (number, name)
        assert got[number]["games"] == each[0]["games"] and got[number]["last_game"] == each[0]["last_game"]
    marked = market.starters(market.project(df, rows.where("id IN (1, 2, 7)").withColumn("team", F.lit("t")), 180, 730, 0), ["team", "role"])
    assert [r["id"] for r in marked.where("projected_starter").collect()] == [1]
    coach = market.coaches(marked, spark.createDataFrame([("t",), ("none",)], "team string"), ["team"]).orderBy("team").collect()
    assert (coach[0]["projected_players"], coach[0]["starters"]) == (0, "") and (coach[1]["projected_players"], coach[1]["starters"]) == (1, "ANN")


def test_value_choices_break_ties_by_likelihood_then_name(spark):
    df = spark.createDataFrame([(1, "x", 0.2, 1.0), (1, "y", 0.3, 1.0), (2, "b", 0.1, 0.5), (2, "a", 0.1, 0.5)], "k int, item string, p double, bonus double")
    got = {r["k"]: r["item"] for r in rolling.value_choices(df, ["k"], "item", "p", "bonus", []).collect()}
    assert got == {1: "y", 2: "a"}


def test_buckets_of_time_follow_the_rows(spark):
    df = spark.createDataFrame([(k * DAY,) for k in range(100)], "t long")
    assert asof.bucket_length(df, "t") == DAY and asof.bucket_length(df.limit(0), "t") == 1
    small = asof.bucket_length(df, "t", 10 * 1)
    assert small == DAY and asof.bucket_length(df.union(df).union(df), "t", 1) == 99 * DAY // 300 + 1
    rows = spark.createDataFrame([(k, "ab"[k % 2], (k * 7919) % (3 * DAY), float(k)) for k in range(200)], "n long, k string, t long, v double")
    wide, narrow = ({r["n"]: r["s"] for r in asof.hot_frame_sums(rows, "n", ["k"], "t", {"s": F.col("v")}, 1.0, bucket).collect()} for bucket in (DAY, 12_345_678))
    assert wide == narrow and len(wide) == 200


def test_streamed_pools_put_late_rows_in_their_place(spark, tmp_path):
    import datetime

    from driftline.streaming import pools

    start = datetime.datetime(2024, 1, 1)
    at = lambda hours: start + datetime.timedelta(hours=hours)
    files = [[(1, "k", at(5), "b"), (2, "k", at(30), "c")], [(3, "k", at(20), "a"), (4, "q", at(31), "x")], [(5, "k", at(2), "z"), (6, "k", at(90), "d")], [(7, "far", at(200), "y")]]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, "row long, key string, ts timestamp, item string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row long, key string, ts timestamp, item string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["row"]: (r["first_item"], r["pool"]) for r in pools.drained(pools.running_pools(stream, "key", "row", "ts", "item", "12 hours"), str(tmp_path / "out")).collect()}
    # row 3 came late and stands before row 2; row 5 came after the watermark had passed it; row 7 still waits
    assert got == {1: ("b", []), 3: ("b", ["b"]), 2: ("b", ["a", "b"]), 4: ("x", []), 6: ("b", ["a", "b", "c"])}
