"""Draft queries: each user's events, twenty at a time, are the bans and picks of a game."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions.numbers import half_even
from driftline.operators import banstudy, drafts, models, profiles, rolling, walkforward
from driftline.operators import sequences as seq
from driftline.plans.base import Plans, micros, rounded, stored, table

plans = Plans()
#: Hours between games of one series; a user's twenty events take days.
GAP_HOURS = 480


def team_rows(spark, sf_dir):
    """Both sides of each game: the first ten of twenty events are Blue's, five bans and five picks a side."""
    df = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    df = df.withColumns({"block": F.floor(F.col("rn") / 20), "s": F.floor(F.col("rn") % 20 / 10), "k": F.col("rn") % 10, "c": F.concat(F.lit("c"), F.col("event_id") % 40)})
    items = [F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("rn", "c")))), lambda x: x["c"]) for ok in (F.col("k") < 5, F.col("k") >= 5)]
    return df.groupBy("user_id", "block", "s").agg(F.min("ts").alias("date"), items[0].alias("bans"), items[1].alias("picks")).select(
        (F.col("user_id") * 100000 + F.col("block")).alias("gameid"), F.when(F.col("s") == 0, "Blue").otherwise("Red").alias("side"),
        F.concat(F.lit("t"), "user_id", F.when(F.col("s") == 0, "a").otherwise("b")).alias("teamname"), F.col("date").cast("timestamp").alias("date"),
        (F.col("block") + 1).alias("game"), (F.col("user_id") % 3 == F.col("s")).cast("int").alias("firstPick"), "bans", "picks",
    )


def games(spark, sf_dir):
    return seq.series(seq.canonical_games(team_rows(spark, sf_dir)), GAP_HOURS)


_GAMES = f"""e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
tr AS (SELECT user_id, rn // 20 AS block, (rn % 20) // 10 AS s, min(ts) AS date, coalesce(list('c' || (event_id % 40) ORDER BY rn) FILTER (rn % 10 < 5), []) AS bans, coalesce(list('c' || (event_id % 40) ORDER BY rn) FILTER (rn % 10 >= 5), []) AS picks FROM e GROUP BY ALL),
cg AS (SELECT x.user_id * 100000 + x.block AS gameid, x.block + 1 AS game, 't' || x.user_id || 'a' AS blue_team, 't' || x.user_id || 'b' AS red_team, x.user_id, x.date, x.bans AS bb, x.picks AS bp, y.bans AS rb, y.picks AS rp,
 CASE WHEN x.user_id % 3 = 1 THEN 'Red' ELSE 'Blue' END AS first_side, x.user_id % 3 = 2 AS first_side_inferred, len(x.bans) = 5 AND len(x.picks) = 5 AND len(y.bans) = 5 AND len(y.picks) = 5 AS complete FROM tr x JOIN tr y ON x.user_id = y.user_id AND x.block = y.block AND x.s = 0 AND y.s = 1),
sg AS (SELECT *, last_value(CASE WHEN fresh THEN gameid END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY date, game, gameid ROWS UNBOUNDED PRECEDING) AS series_id FROM (SELECT *, coalesce(game = 1 OR game <> lag(game) OVER w + 1 OR epoch_us(date) - lag(epoch_us(date)) OVER w > {GAP_HOURS} * 3600000000, true) AS fresh FROM cg WINDOW w AS (PARTITION BY user_id ORDER BY date, game, gameid)))"""


@plans.query("canonical_games", f"WITH {_GAMES} SELECT gameid, game, blue_team, red_team, first_side, first_side_inferred, complete, series_id FROM sg")
def canonical_games(spark, sf_dir):
    return games(spark, sf_dir).select("gameid", "game", "blue_team", "red_team", "first_side", "first_side_inferred", "complete", "series_id")


_STEPS = ", ".join(f"({i + 1}, '{p}', '{k}', '{s}', {n})" for i, (p, k, s, n) in enumerate(seq.DRAFT_ORDER))
_ACTIONS = f"""{_GAMES}, steps(action_number, action_phase, action_type, relative_side, slot) AS (VALUES {_STEPS}),
ac AS (SELECT gameid, series_id, date, game, user_id, action_number, action_phase, action_type, side, CASE WHEN side = 'Blue' THEN CASE WHEN action_type = 'ban' THEN bb ELSE bp END ELSE CASE WHEN action_type = 'ban' THEN rb ELSE rp END END[slot] AS champion FROM (SELECT *, CASE WHEN relative_side = 'first' THEN first_side WHEN first_side = 'Blue' THEN 'Red' ELSE 'Blue' END AS side FROM sg, steps) WHERE champion IS NOT NULL)"""
_PRIOR = "string_agg(CASE WHEN action_type = '{}' THEN champion END, ',') OVER (PARTITION BY gameid ORDER BY action_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@plans.query("draft_expand", f"WITH {_ACTIONS} SELECT gameid, action_number, action_phase, action_type, side, champion FROM ac")
def draft_expand(spark, sf_dir):
    return seq.expand_drafts(games(spark, sf_dir)).select("gameid", "action_number", "action_phase", "action_type", "side", "champion")


@plans.query("draft_actions", f"""WITH {_ACTIONS},
po AS (SELECT g.gameid, list_sort(list_distinct(flatten(list(list_concat(h.bp, h.rp))))) AS pool FROM sg g JOIN sg h ON h.series_id = g.series_id AND (h.date, h.game, h.gameid) < (g.date, g.game, g.gameid) GROUP BY 1),
st AS (SELECT ac.*, coalesce({_PRIOR.format('pick')}, '') AS picked_before, coalesce({_PRIOR.format('ban')}, '') AS banned_before, coalesce(pool, []) AS pool FROM ac LEFT JOIN po USING (gameid))
SELECT gameid, action_number, side, champion, picked_before, banned_before, array_to_string(pool, ',') AS pool, concat_ws(',', CASE WHEN list_contains(string_split(picked_before || ',' || banned_before, ','), champion) THEN 'current_draft_duplicate' END, CASE WHEN list_contains(pool, champion) THEN 'fearless_unavailable' END) AS conflicts FROM st""")
def draft_actions(spark, sf_dir):
    df = seq.draft_actions(games(spark, sf_dir))
    joined = (F.array_join(c, ",").alias(c) for c in ("picked_before", "banned_before", "pool"))
    return df.select("gameid", "action_number", "side", "champion", *joined, "conflicts")


@plans.query("player_assignment", f"""WITH {_ACTIONS}, pl AS (SELECT gameid, side, champion, max('p' || length(champion) || action_number % 5) AS player FROM ac WHERE action_type = 'pick' AND gameid % 2 = 0 GROUP BY ALL)
SELECT ac.gameid, action_number, champion, pl.player FROM ac LEFT JOIN pl USING (gameid, side, champion)""")
def player_assignment(spark, sf_dir):
    actions = seq.expand_drafts(games(spark, sf_dir))
    name = F.concat(F.lit("p"), F.length("champion"), F.col("action_number") % 5)
    players = actions.where("action_type = 'pick' AND gameid % 2 = 0").groupBy("gameid", "side", "champion").agg(F.max(name).alias("player"))
    return drafts.assign_players(actions, players, ["gameid", "side", "champion"], ["player"]).select("gameid", "action_number", "champion", "player")


def _roles(spark, sf_dir, rows=None):
    events = table(spark, sf_dir, "events")
    counts = (events if rows is None else events.where(rows)).groupBy(F.concat(F.lit("c"), F.col("event_id") % 40).alias("champion"), F.col("event_type").alias("role")).agg(F.count("*").alias("n"))
    return counts.select("champion", "role", (F.col("n") / F.sum("n").over(Window.partitionBy("champion"))).alias("p"))


_ROLES = "ro AS (SELECT champion, event_type AS role, n::DOUBLE / (sum(n) OVER (PARTITION BY champion))::DOUBLE AS p FROM (SELECT 'c' || (event_id % 40) AS champion, event_type, count(*) AS n FROM events GROUP BY ALL))"


@plans.query("role_open", f"""WITH {_GAMES}, {_ROLES}, un AS (SELECT DISTINCT champion FROM ro), en AS (SELECT DISTINCT gameid, unnest(rp) AS champion FROM sg), fi AS (SELECT gameid, role, product(1 - p) AS unfilled FROM en JOIN ro USING (champion) GROUP BY ALL)
SELECT gameid, champion, round_even(CASE WHEN len(any_value(rp)) = 0 THEN 1 ELSE greatest(0.05, least(1.0, sum(p * coalesce(unfilled, 1)))) END, 8) AS open FROM sg CROSS JOIN ro LEFT JOIN fi USING (gameid, role) GROUP BY gameid, champion""")
def role_open(spark, sf_dir):
    states = games(spark, sf_dir).select("gameid", F.col("red_picks").alias("enemies"))
    roles = _roles(spark, sf_dir)
    wanted = states.select("gameid").crossJoin(F.broadcast(roles.select("champion").distinct()))
    return drafts.role_open(states, wanted, roles, ["gameid"], "enemies", "champion").select("gameid", "champion", rounded("open", 8).alias("open"))


_VERSION = "'15.' || (game % 6 + 1)"
_META = f"me AS (SELECT league, patch, champion, n::DOUBLE / (sum(n) OVER (PARTITION BY league, patch))::DOUBLE AS prior FROM (SELECT 'l' || (user_id % 3) AS league, {_VERSION} AS patch, champion, count(*) AS n FROM ac WHERE action_type = 'pick' GROUP BY ALL))"


def _actions(spark, sf_dir):
    """All actions with league, patch, teams and the state before each."""
    df = seq.draft_actions(games(spark, sf_dir))
    own, other = F.col("side") == "Blue", F.col("side") == "Red"
    user = F.floor(F.col("gameid") / 100000)
    window = seq.earlier(["gameid"], ["action_number"])
    pick = F.col("action_type") == "pick"
    return df.select(
        (F.col("gameid") * 20 + F.col("action_number") - 1).alias("action_id"), F.concat(F.lit("l"), user % 3).alias("league"), F.concat(F.lit("15."), F.col("game") % 6 + 1).alias("patch"),
        F.when(own, F.col("blue_team")).otherwise(F.col("red_team")).alias("team"), F.when(other, F.col("blue_team")).otherwise(F.col("red_team")).alias("opponent"), "action_type", "action_phase", "champion",
        F.array_union(F.array_union("picked_before", "banned_before"), "pool").alias("unavailable"),
        F.when(own, seq.prior("champion", pick & own, window)).otherwise(seq.prior("champion", pick & other, window)).alias("allies"),
        F.when(own, seq.prior("champion", pick & other, window)).otherwise(seq.prior("champion", pick & own, window)).alias("enemies"), F.col("gameid"), F.col("side"), "date", (F.col("conflicts") == "").alias("legal"),
    )


def _priors(df, keys, name="prior"):
    counts = df.groupBy(*keys, "champion").agg(F.count("*").alias("n"))
    return counts.select(*keys, "champion", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias(name))


@plans.query("meta_gate", f"""WITH {_ACTIONS}, {_META}, pk AS (SELECT league, patch, max(prior) AS peak FROM me GROUP BY ALL), pr AS (SELECT DISTINCT 'l' || (a.user_id % 3) AS league, '15.' || (a.game % 7 + 1) AS patch, a.champion AS c, b.champion AS a FROM ac a JOIN ac b ON a.gameid = b.gameid AND a.side = b.side AND a.champion < b.champion AND a.action_type = 'pick' AND b.action_type = 'pick')
SELECT pr.league, pr.patch, c, a, round_even(CASE WHEN peak > 0 THEN sqrt(least(1.0, coalesce(x.prior, 0) / peak) * least(1.0, coalesce(y.prior, 0) / peak)) ELSE 1 END, 8) AS gate FROM pr LEFT JOIN pk USING (league, patch) LEFT JOIN me x ON x.league = pr.league AND x.patch = pr.patch AND x.champion = c LEFT JOIN me y ON y.league = pr.league AND y.patch = pr.patch AND y.champion = a""")
def meta_gate(spark, sf_dir):
    actions = _actions(spark, sf_dir)
    picks = actions.where("action_type = 'pick'").withColumn("version", F.concat(F.lit("15."), (F.col("gameid") % 100000 + 1) % 7 + 1))
    sides = picks.groupBy("league", "version", "gameid", "side").agg(F.collect_set("champion").alias("items")).withColumn("c", F.explode("items"))
    pairs = sides.select("league", F.col("version").alias("patch"), "c", F.explode("items").alias("a")).where("c < a").distinct()
    return drafts.meta_gate(pairs, _priors(picks, ["league", "patch"]), ["league", "patch"], "champion", "c", "a").select("league", "patch", "c", "a", rounded("gate", 8).alias("gate"))


#: Games from this date on are tested; priors, roles and pairs come from legal actions before it.
_CUTOFF = "2024-01-20"


def _earlier(spark, sf_dir):
    """Legal actions, and what earlier games say: (actions, universe, meta, comfort, opponents, roles, picks)."""
    actions = _actions(spark, sf_dir).where("legal").withColumn("tested", F.col("date") >= F.lit(_CUTOFF).cast("timestamp"))
    known = actions.where("NOT tested")
    picks = known.where("action_type = 'pick'").withColumns({"major": F.lit(15), "group": F.concat_ws("-", "gameid", "side")})
    meta, comfort = _priors(known, ["action_type", "league", "patch"]), _priors(known, ["action_type", "team"], "comfort")
    roles = _roles(spark, sf_dir, F.col("ts") < F.lit(_CUTOFF).cast("timestamp_ntz"))
    return actions, known.select("champion").distinct(), meta, comfort, _priors(picks, ["team"]), roles, picks


def board(spark, sf_dir):
    """(legal actions, their features): earlier games teach all priors, an action's own type its shares."""
    from driftline.operators import versions as ver

    actions, *priors, picks = _earlier(spark, sf_dir)
    boosts = ver.pair_boosts(picks, ["patch"], "group", "champion").withColumnRenamed("patch", "version").select("a", "b", "version", "boost")
    seasons = ver.season_boosts(picks, "major", "group", "champion")
    return actions, drafts.board_features(actions, *priors, lambda wanted: ver.boost_lookup(wanted, boosts, seasons), kept=("tested",))


_BOARD = f"""po AS (SELECT DISTINCT g.gameid, unnest(list_concat(h.bp, h.rp)) AS item FROM sg g JOIN sg h ON h.series_id = g.series_id AND (h.date, h.game, h.gameid) < (g.date, g.game, g.gameid)),
lg AS (SELECT *, 'l' || (user_id % 3) AS league, {_VERSION} AS patch FROM ac WHERE NOT EXISTS (SELECT 1 FROM po WHERE po.gameid = ac.gameid AND po.item = ac.champion) AND NOT EXISTS (SELECT 1 FROM ac b WHERE b.gameid = ac.gameid AND b.action_number < ac.action_number AND b.champion = ac.champion)),
kn AS (SELECT * FROM lg WHERE date < '{_CUTOFF}'), un AS (SELECT DISTINCT champion AS item FROM kn),
me AS (SELECT action_type, league, patch, champion, n::DOUBLE / (sum(n) OVER (PARTITION BY action_type, league, patch))::DOUBLE AS prior FROM (SELECT action_type, league, patch, champion, count(*) AS n FROM kn GROUP BY ALL)),
ro AS (SELECT champion, event_type AS role, n::DOUBLE / (sum(n) OVER (PARTITION BY champion))::DOUBLE AS p FROM (SELECT 'c' || (event_id % 40) AS champion, event_type, count(*) AS n FROM events WHERE ts < '{_CUTOFF}' GROUP BY ALL)),
la AS (SELECT ac.gameid, ac.action_number, action_type, action_phase, side, champion, user_id, game, date, league, patch, item FROM lg ac CROSS JOIN un WHERE item = champion OR (NOT EXISTS (SELECT 1 FROM po WHERE po.gameid = ac.gameid AND po.item = un.item) AND NOT EXISTS (SELECT 1 FROM ac b WHERE b.gameid = ac.gameid AND b.action_number < ac.action_number AND b.champion = un.item))),
co AS (SELECT action_type, user_id, side, champion, n::DOUBLE / (sum(n) OVER (PARTITION BY action_type, user_id, side))::DOUBLE AS prior FROM (SELECT action_type, user_id, side, champion, count(*) AS n FROM kn GROUP BY ALL))"""
_GATE = "mp AS (SELECT * FROM me WHERE action_type = 'pick'), pk AS (SELECT league, patch, max(prior) AS peak FROM mp GROUP BY ALL)"


@plans.query("board_features", f"""WITH {_ACTIONS}, {_BOARD},
pg AS (SELECT DISTINCT patch, gameid, side, champion FROM kn WHERE action_type = 'pick'), ga AS (SELECT patch, champion, count(*) AS g FROM pg GROUP BY ALL), gs AS (SELECT champion, count(*) AS g FROM pg GROUP BY ALL),
pp AS (SELECT x.patch, x.champion AS a, y.champion AS b, count(*) AS n FROM pg x JOIN pg y ON x.gameid = y.gameid AND x.side = y.side AND x.champion < y.champion GROUP BY ALL),
bo AS (SELECT a, b, split_part(pp.patch, '.', 2)::INT AS hn, 15 AS hm, least(0.25, n::DOUBLE / least(p.g, q.g) * n / (n + 8)) AS boost FROM pp JOIN ga p ON p.patch = pp.patch AND p.champion = a JOIN ga q ON q.patch = pp.patch AND q.champion = b WHERE n >= 3),
{_GATE},
al AS (SELECT DISTINCT l.gameid, l.action_number, l.item, b.champion AS ally, l.league, l.patch, split_part(l.patch, '.', 2)::INT AS tn FROM la l JOIN ac b ON b.gameid = l.gameid AND b.side = l.side AND b.action_number < l.action_number AND b.action_type = 'pick' WHERE l.action_type = 'pick'),
bs AS (SELECT al.gameid, al.action_number, al.item, al.ally, al.league, al.patch, least(0.25, avg(boost * exp(-0.15 * (tn - hn)))) AS boost FROM al JOIN bo ON a = least(item, ally) AND b = greatest(item, ally) AND hn <= tn AND tn - hn <= 4 GROUP BY ALL),
tg AS (SELECT bs.gameid, bs.action_number, bs.item, sum(boost * CASE WHEN peak > 0 THEN sqrt(least(1.0, coalesce(x.prior, 0) / peak) * least(1.0, coalesce(y.prior, 0) / peak)) ELSE 1 END) AS target FROM bs LEFT JOIN pk USING (league, patch) LEFT JOIN mp x ON x.league = bs.league AND x.patch = bs.patch AND x.champion = item LEFT JOIN mp y ON y.league = bs.league AND y.patch = bs.patch AND y.champion = ally GROUP BY ALL),
en AS (SELECT DISTINCT a.gameid, a.action_number, b.champion FROM ac a JOIN ac b ON b.gameid = a.gameid AND b.side <> a.side AND b.action_number < a.action_number AND b.action_type = 'pick' WHERE a.action_phase = 'ban2'), fi AS (SELECT gameid, action_number, role, product(1 - p) AS unfilled FROM en JOIN ro USING (champion) GROUP BY ALL),
op AS (SELECT a.gameid, a.action_number, ro.champion AS item, greatest(0.05, least(1.0, sum(p * coalesce(unfilled, 1)))) AS open FROM (SELECT DISTINCT gameid, action_number FROM en) a CROSS JOIN ro LEFT JOIN fi ON fi.gameid = a.gameid AND fi.action_number = a.action_number AND fi.role = ro.role GROUP BY ALL)
SELECT la.gameid * 20 + la.action_number - 1 AS action_id, la.item, la.item = la.champion AS chosen, round_even(coalesce(me.prior, 0.001), 8) AS meta, round_even(coalesce(co.prior, 0), 8) AS comfort,
 round_even(CASE WHEN la.action_type = 'pick' THEN coalesce(tg.target, 0) ELSE coalesce(ot.prior, 0) * CASE WHEN la.action_phase = 'ban2' THEN coalesce(op.open, 1) ELSE 1 END END, 8) AS target, round_even(coalesce(me.prior, 0.001) * CASE WHEN la.action_phase IN ('pick1', 'ban1') THEN 1 ELSE 0.8 END, 8) AS phase
FROM la LEFT JOIN me ON me.action_type = la.action_type AND me.league = la.league AND me.patch = la.patch AND me.champion = la.item LEFT JOIN co ON co.action_type = la.action_type AND co.user_id = la.user_id AND co.side = la.side AND co.champion = la.item LEFT JOIN co ot ON ot.action_type = 'pick' AND ot.user_id = la.user_id AND ot.side <> la.side AND ot.champion = la.item
 LEFT JOIN tg ON tg.gameid = la.gameid AND tg.action_number = la.action_number AND tg.item = la.item LEFT JOIN op ON op.gameid = la.gameid AND op.action_number = la.action_number AND op.item = la.item""")
def board_features(spark, sf_dir):
    return board(spark, sf_dir)[1].select("action_id", "item", "chosen", *(rounded(c, 8).alias(c) for c in ("meta", "comfort", "target", "phase")))


@plans.query("board_ranker")
def board_ranker(spark, sf_dir):
    """For picks and for bans: weights fitted on earlier games, and rank metrics on later ones."""
    actions, features = (stored(x, n) for x, n in zip(board(spark, sf_dir), ("actions", "features"), strict=True))
    found = []
    for kind in ("pick", "ban"):
        of_kind = features.where(F.col("action_type") == kind)
        weights = drafts.fit_board(of_kind.where("NOT tested"))
        metrics = drafts.evaluate_board(actions.where((F.col("action_type") == kind) & F.col("tested")), of_kind.where("tested"), weights)
        found.append(metrics.select(F.lit(kind).alias("action_type"), *metrics.columns, *(F.lit(float(w)).alias(f"w_{c}") for c, w in zip(drafts.BOARD_FEATURES, weights, strict=True))))
    return found[0].unionByName(found[1])


_NB_FEATURES = ["league", "patch", "team", "opponent", "action_phase"]
_NB_PARTS = " + ".join(f"ln((coalesce(f{i}.n, 0) + 1) / (cw.n + nv{i}.n + CASE WHEN sn{i}.v IS NULL THEN 1 ELSE 0 END))" for i in range(len(_NB_FEATURES)))
_NB_JOINS = " ".join(f"JOIN nv nv{i} ON nv{i}.action_type = te.action_type AND nv{i}.feature = '{c}' LEFT JOIN sn sn{i} ON sn{i}.action_type = te.action_type AND sn{i}.feature = '{c}' AND sn{i}.v = te.{c} LEFT JOIN fc f{i} ON f{i}.action_type = te.action_type AND f{i}.feature = '{c}' AND f{i}.v = te.{c} AND f{i}.champion = te.item" for i, c in enumerate(_NB_FEATURES))


@plans.query("bayes_backtest", f"""WITH {_ACTIONS}, {_BOARD}, tk AS (SELECT *, 't' || user_id || CASE WHEN side = 'Blue' THEN 'a' ELSE 'b' END AS team, 't' || user_id || CASE WHEN side = 'Blue' THEN 'b' ELSE 'a' END AS opponent FROM kn),
cw AS (SELECT action_type, champion, count(*)::DOUBLE AS n FROM tk GROUP BY ALL), ct AS (SELECT action_type, sum(n) AS total, count(*) AS classes FROM cw GROUP BY 1),
lo AS (SELECT action_type, champion, unnest([{', '.join(repr(c) for c in _NB_FEATURES)}]) AS feature, unnest([{', '.join(_NB_FEATURES)}]) AS v FROM tk), fc AS (SELECT action_type, feature, v, champion, count(*)::DOUBLE AS n FROM lo GROUP BY ALL), sn AS (SELECT DISTINCT action_type, feature, v FROM lo), nv AS (SELECT action_type, feature, count(*) AS n FROM sn GROUP BY ALL),
te AS (SELECT *, 't' || user_id || CASE WHEN side = 'Blue' THEN 'a' ELSE 'b' END AS team, 't' || user_id || CASE WHEN side = 'Blue' THEN 'b' ELSE 'a' END AS opponent FROM la WHERE date >= '{_CUTOFF}'),
sc AS (SELECT te.action_type, te.gameid, te.action_number, te.item, te.item = te.champion AS chosen, ln((cw.n + 1) / (ct.total + ct.classes)) + {_NB_PARTS} AS lg FROM te JOIN cw ON cw.action_type = te.action_type AND cw.champion = te.item JOIN ct ON ct.action_type = te.action_type {_NB_JOINS}),
pr AS (SELECT *, exp(lg) / sum(exp(lg)) OVER (PARTITION BY gameid, action_number) AS p FROM sc), rk AS (SELECT *, row_number() OVER (PARTITION BY gameid, action_number ORDER BY round_even(p, 9) DESC, item) AS r FROM pr),
al AS (SELECT DISTINCT action_type, gameid, action_number FROM te)
SELECT action_type, count(*) AS targets, round_even(avg(coalesce((r <= 1)::INT, 0)), 6) AS top1, round_even(avg(coalesce((r <= 5)::INT, 0)), 6) AS top5, round_even(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round_even(avg(-ln(greatest(p, 1e-15))), 6) AS log_loss FROM al LEFT JOIN (SELECT * FROM rk WHERE chosen) USING (action_type, gameid, action_number) GROUP BY 1""")
def bayes_backtest(spark, sf_dir):
    """Naive Bayes of picks and of bans, learned from earlier legal actions and ranked among what later boards leave."""
    actions = _earlier(spark, sf_dir)[0].select("action_id", "action_type", *_NB_FEATURES, "champion", "unavailable", "tested")
    actions = stored(actions, "actions")
    universe = actions.where("NOT tested").agg(F.collect_set("champion").alias("_items"))
    found = []
    for kind in ("pick", "ban"):
        mine = actions.where(F.col("action_type") == kind)
        train, test = mine.where("NOT tested"), mine.where("tested")
        chances = models.label_chances(train, test, _NB_FEATURES, "champion").crossJoin(universe)
        legal = lambda item: F.array_contains("_items", item) & (~F.coalesce(F.array_contains("unavailable", item), F.lit(False)) | (item == F.col("champion")))
        own = F.filter(models.ranked_list("chances", legal), lambda x: x["label"] == F.col("champion"))
        own = chances.select(F.get(own, F.lit(0)).alias("_own")).select("_own.rank", "_own.probability")
        metrics = models.rank_metrics(own, "rank", "probability")
        found.append(metrics.select(F.lit(kind).alias("action_type"), "targets", *(rounded(c, 6).alias(c) for c in ("top1", "top5", "mrr", "log_loss"))))
    return found[0].unionByName(found[1])


def _walk_forward(spark, sf_dir, pairs: bool):
    """(tested picks, features of all picks) with pair strengths of the picks before each tested week, and of all earlier games for those."""
    actions, *priors, _ = _earlier(spark, sf_dir)
    actions = actions.where("action_type = 'pick'").withColumn("time", F.unix_micros("date"))
    locked = F.unix_micros(F.lit(_CUTOFF).cast("timestamp"))
    actions = actions.withColumn("week", F.when(F.col("tested"), walkforward.week_start(F.col("time"))).otherwise(locked))
    picks = actions.select(F.col("patch").alias("version"), F.concat_ws("-", "gameid", "side").alias("group"), "champion", "time")
    strength = walkforward.pair_strength(picks, "group", "champion", "time") if pairs else None
    features = drafts.board_features(actions, *priors, strength, keys=("week",))
    return actions.where("tested"), features.join(actions.select("action_id", "tested"), "action_id")


_METRICS = ["targets", "top1", "top5", "mrr", "log_loss"]


@plans.query("pair_ablation", f"""WITH {_ACTIONS}, {_BOARD}, {_GATE}, wk AS (SELECT DISTINCT date_trunc('week', date) AS week FROM lg WHERE action_type = 'pick' AND date >= '{_CUTOFF}'), pg AS (SELECT DISTINCT patch, gameid, side, champion, date FROM lg WHERE action_type = 'pick'),
ga AS (SELECT week, patch, champion, count(*) AS g FROM wk JOIN pg ON pg.date < week GROUP BY ALL), pp AS (SELECT week, x.patch, x.champion AS a, y.champion AS b, count(*) AS n FROM wk JOIN pg x ON x.date < week JOIN pg y ON x.gameid = y.gameid AND x.side = y.side AND x.champion < y.champion GROUP BY ALL),
bo AS (SELECT pp.week, a, b, split_part(pp.patch, '.', 2)::INT AS hn, least(0.25, n::DOUBLE / least(p.g, q.g) * n / (n + 8)) AS boost FROM pp JOIN ga p ON p.week = pp.week AND p.patch = pp.patch AND p.champion = a JOIN ga q ON q.week = pp.week AND q.patch = pp.patch AND q.champion = b WHERE n >= 3),
te AS (SELECT *, date_trunc('week', date) AS week FROM la WHERE action_type = 'pick' AND date >= '{_CUTOFF}'),
al AS (SELECT DISTINCT l.gameid, l.action_number, l.item, b.champion AS ally, l.league, l.patch, l.week, split_part(l.patch, '.', 2)::INT AS tn FROM te l JOIN ac b ON b.gameid = l.gameid AND b.side = l.side AND b.action_number < l.action_number AND b.action_type = 'pick'),
bs AS (SELECT al.gameid, al.action_number, al.item, al.ally, al.league, al.patch, least(0.25, avg(boost * exp(-0.15 * (tn - hn)))) AS boost FROM al JOIN bo ON bo.week = al.week AND a = least(item, ally) AND b = greatest(item, ally) AND hn <= tn AND tn - hn <= 4 GROUP BY ALL),
tg AS (SELECT bs.gameid, bs.action_number, bs.item, sum(boost * CASE WHEN peak > 0 THEN sqrt(least(1.0, coalesce(x.prior, 0) / peak) * least(1.0, coalesce(y.prior, 0) / peak)) ELSE 1 END) AS target FROM bs LEFT JOIN pk USING (league, patch) LEFT JOIN mp x ON x.league = bs.league AND x.patch = bs.patch AND x.champion = item LEFT JOIN mp y ON y.league = bs.league AND y.patch = bs.patch AND y.champion = ally GROUP BY ALL),
sc AS (SELECT te.gameid, te.action_number, te.item, te.item = te.champion AS chosen, variant, 2.5 * coalesce(mp.prior, 0.001) + 1.8 * coalesce(co.prior, 0) + 0.8 * coalesce(mp.prior, 0.001) * CASE WHEN te.action_phase = 'pick1' THEN 1 ELSE 0.8 END + CASE WHEN variant = 'with' THEN 1.2 * coalesce(tg.target, 0) ELSE 0 END AS z
 FROM te CROSS JOIN (VALUES ('with'), ('without')) v(variant) LEFT JOIN mp ON mp.league = te.league AND mp.patch = te.patch AND mp.champion = te.item LEFT JOIN co ON co.action_type = 'pick' AND co.user_id = te.user_id AND co.side = te.side AND co.champion = te.item LEFT JOIN tg ON tg.gameid = te.gameid AND tg.action_number = te.action_number AND tg.item = te.item),
pr AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY variant, gameid, action_number) AS p FROM sc), rk AS (SELECT *, row_number() OVER (PARTITION BY variant, gameid, action_number ORDER BY round_even(p, 9) DESC, item) AS r FROM pr),
mt AS (SELECT variant, count(*)::DOUBLE AS targets, avg((r <= 1)::INT) AS top1, avg((r <= 5)::INT) AS top5, avg(1.0 / r) AS mrr, avg(-ln(p)) AS log_loss FROM rk WHERE chosen GROUP BY 1)
SELECT variant, {', '.join(f'round_even({c}, 6) AS {c}' for c in _METRICS)} FROM (SELECT * FROM mt UNION ALL SELECT 'difference', {', '.join(f'x.{c} - y.{c}' for c in _METRICS)} FROM mt x, mt y WHERE x.variant = 'with' AND y.variant = 'without')""")
def pair_ablation(spark, sf_dir):
    """What pair strengths, known before each week, add to the ranks of later picks, at the start weights."""
    found = []
    for pairs in (True, False):
        tested, features = (stored(x, n) for x, n in zip(_walk_forward(spark, sf_dir, pairs), ("tested", "features"), strict=True))
        found.append(drafts.evaluate_board(tested, features.where("tested"), drafts.BOARD_START))
    return walkforward.deltas(*found, _METRICS)


@plans.query("pair_ablation_fitted")
def pair_ablation_fitted(spark, sf_dir):
    """The same with weights fitted on earlier picks, once with pairs and once without."""
    found = []
    for pairs in (True, False):
        tested, features = (stored(x, n) for x, n in zip(_walk_forward(spark, sf_dir, pairs), ("tested", "features"), strict=True))
        found.append(drafts.evaluate_board(tested, features.where("tested"), drafts.fit_board(features.where("NOT tested"))))
    return walkforward.deltas(*found, _METRICS)


_TAGS = "tg AS (SELECT DISTINCT 'tag' || (p_size % 5) AS tag, p_brand AS item FROM part WHERE p_size <= 10)"
_RULES = "ru AS (SELECT s_suppkey AS rule, 'S' || s_suppkey AS counter, 'm' || (s_suppkey % 4) AS mechanism, (s_suppkey % 3)::DOUBLE AS severity, ['Brand#' || (s_suppkey % 5 + 1) || '1', 'brand#' || (s_suppkey % 5 + 1) || '2'] AS targets, CASE WHEN s_suppkey % 2 = 0 THEN 'tag' || (s_suppkey % 7) END AS target_tag FROM supplier)"


@plans.query("cross_lane_counters", f"""WITH {_TAGS}, {_RULES}, it AS (SELECT DISTINCT upper(p_brand) AS item FROM part), hit AS (SELECT item, rule FROM it JOIN (SELECT rule, unnest(targets) AS t FROM ru) ON lower(t) = lower(item) UNION SELECT it.item, rule FROM it JOIN tg ON lower(tg.item) = lower(it.item) JOIN ru ON target_tag = tag)
SELECT item, counter, mechanism, severity FROM hit JOIN ru USING (rule)""")
def cross_lane_counters(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tags = part.where("p_size <= 10").select(F.concat(F.lit("tag"), F.col("p_size") % 5).alias("tag"), F.col("p_brand").alias("item")).distinct()
    number = F.col("s_suppkey")
    targets = F.array(F.concat(F.lit("Brand#"), number % 5 + 1, F.lit("1")), F.concat(F.lit("brand#"), number % 5 + 1, F.lit("2")))
    rules = table(spark, sf_dir, "supplier").select(number.alias("rule"), F.concat(F.lit("S"), number).alias("counter"), F.concat(F.lit("m"), number % 4).alias("mechanism"), (number % 3).cast("double").alias("severity"), targets.alias("targets"), F.when(number % 2 == 0, F.concat(F.lit("tag"), number % 7)).alias("target_tag"))
    return drafts.cross_lane_counters(part.select(F.upper("p_brand").alias("item")).distinct(), tags, rules, "item")


@plans.query("archetypes", f"WITH {_TAGS} SELECT DISTINCT upper(item) AS item, tag FROM tg")
def archetypes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tags = part.where("p_size <= 10").select(F.concat(F.lit("tag"), F.col("p_size") % 5).alias("tag"), F.col("p_brand").alias("item")).distinct()
    return drafts.archetypes(part.select(F.upper("p_brand").alias("item")).distinct(), tags, "item")


_SYNERGY = [(1, ["Brand#11", "Brand#12"], 1.2), (2, ["Brand#12", "brand#13", "Brand#14"], 1.4), (3, ["Brand#11", "Brand#12"], 9.0), (4, ["Brand#21", "Brand#22"], 1.0)]
_ANCHORS = [("Brand#21", "brand#22"), ("Brand#31", "Brand#32"), ("Brand#12", "Brand#13")]


@plans.query("pair_priority", f"""WITH sy(rank, members, score) AS (VALUES {', '.join(f"({r}, {m}, {s}::DOUBLE)" for r, m, s in _SYNERGY)}), an(x, y) AS (VALUES {', '.join(map(str, _ANCHORS))}),
t AS (SELECT p_brand, min(p_size) % 4 * 0.25 + 0.7 AS tier FROM part GROUP BY 1), pr AS (SELECT p.p_brand AS a, q.p_brand AS b, p.tier AS ta, q.tier AS tb FROM t p, t q),
ba AS (SELECT *, coalesce((SELECT arg_min(score, rank) FROM sy WHERE lower(a) <> lower(b) AND list_contains(list_transform(members, lambda m: lower(m)), lower(a)) AND list_contains(list_transform(members, lambda m: lower(m)), lower(b))), 1) AS base FROM pr)
SELECT a, b, round_even(CASE WHEN base = 1 AND EXISTS (SELECT 1 FROM an WHERE (lower(x) = lower(a) AND lower(y) = lower(b)) OR (lower(x) = lower(b) AND lower(y) = lower(a))) THEN 1.35 ELSE base END * ta * tb * 1.5, 4) AS priority FROM ba""")
def pair_priority(spark, sf_dir):
    tiers = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.min("p_size") % 4 * 0.25 + 0.7).alias("tier"))
    pairs = tiers.select(F.col("p_brand").alias("a"), F.col("tier").alias("ta")).crossJoin(F.broadcast(tiers.select(F.col("p_brand").alias("b"), F.col("tier").alias("tb")))).withColumn("comfort", F.lit(1.5))
    synergies = spark.createDataFrame(_SYNERGY, "rank int, members array<string>, score double")
    return drafts.pair_priority(pairs, synergies, spark.createDataFrame(_ANCHORS, "a string, b string"), "ta", "tb", "comfort").select("a", "b", "priority")


@plans.query("opponent_rates", f"""WITH {_ACTIONS}, a AS (SELECT *, 't' || user_id || CASE WHEN side = 'Blue' THEN 'a' ELSE 'b' END AS team, {_VERSION} AS patch FROM ac),
t AS (SELECT DISTINCT gameid AS target, 't' || user_id || 'b' AS opponent, date AS cutoff, CASE WHEN user_id % 2 = 0 THEN '15.99' ELSE {_VERSION} END AS patch FROM sg), p AS (SELECT t.target, t.opponent, t.cutoff, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.date < t.cutoff AND a.date >= t.cutoff - INTERVAL 20 DAY AND a.patch = t.patch) THEN t.patch ELSE '' END AS pool FROM t),
m AS (SELECT p.target, p.opponent, a.* FROM p JOIN a ON a.date < p.cutoff AND a.date >= p.cutoff - INTERVAL 20 DAY AND (p.pool = '' OR a.patch = p.pool)),
g AS (SELECT target, count(DISTINCT gameid) AS public, count(DISTINCT CASE WHEN team = opponent THEN gameid END) AS games FROM m GROUP BY 1),
o AS (SELECT target, champion, sum((action_type = 'ban')::INT) AS b, sum((action_type = 'pick')::INT) AS k FROM m WHERE team = opponent GROUP BY ALL), u AS (SELECT target, champion, sum((action_type = 'ban')::INT) AS pb FROM m GROUP BY ALL)
SELECT o.target, o.champion, round_even(b::DOUBLE / games, 6) AS ban_rate, round_even(k::DOUBLE / games, 6) AS pick_rate, round_even(pb::DOUBLE / public, 6) AS public_ban_rate, games FROM o JOIN g USING (target) JOIN u ON u.target = o.target AND u.champion = o.champion""")
def opponent_rates(spark, sf_dir):
    """Each game's opponent as known before it: its bans and picks of the last days, of the game's patch if anybody has played it (half of the games name a patch that nobody has)."""
    # games and their actions are read by every count
    found = stored(games(spark, sf_dir), "games")
    df = seq.draft_actions(found)
    patch = F.concat(F.lit("15."), F.col("game") % 6 + 1)
    team = F.when(F.col("side") == "Blue", F.col("blue_team")).otherwise(F.col("red_team"))
    actions = df.select(F.col("gameid").alias("game"), team.alias("team"), F.unix_micros("date").alias("time"), patch.alias("patch"), "action_type", "champion")
    actions = stored(actions, "actions")
    targets = found.select(F.col("gameid").alias("target"), F.col("red_team").alias("opponent"), F.unix_micros("date").alias("cutoff"), F.when(F.floor(F.col("gameid") / 100000) % 2 == 0, "15.99").otherwise(patch).alias("patch"))
    found = profiles.draft_rates_before(actions, targets, days=20)
    return found.select("target", "champion", *(half_even(c, 6).alias(c) for c in ("ban_rate", "pick_rate", "public_ban_rate")), "games")


_TARGETS = "tt AS (SELECT user_id, date_trunc('week', ts) AS week, user_id % 5 AS role, min(ts) AS start, arg_min(event_id % 4, (ts, event_id)) AS version, list(DISTINCT event_type) AS actual FROM events WHERE ts >= '2024-01-15' GROUP BY ALL)"
_W = "pow(0.5, (epoch_us(start) - epoch_us(ts)) / (90 * 86400000000.0))"
_SCORES = f"""{_TARGETS}, hi AS (SELECT *, user_id % 5 AS role, event_id % 4 AS version FROM events),
ms AS (SELECT t.user_id, t.week, h.event_type AS item, sum({_W} * CASE WHEN h.version = t.version THEN 1 ELSE 0.15 END) AS w FROM tt t JOIN hi h ON h.role = t.role AND h.ts < t.start AND h.ts >= t.start - INTERVAL 10 DAY GROUP BY ALL),
ps AS (SELECT t.user_id, t.week, h.event_type AS item, sum({_W}) AS w FROM tt t JOIN hi h ON h.user_id = t.user_id AND h.ts < t.start AND h.ts >= t.start - INTERVAL 10 DAY GROUP BY ALL),
sc AS (SELECT user_id, week, item, 0.7 * (m.w / sum(m.w) OVER g) + 0.3 * coalesce(p.w / sum(p.w) OVER g, 0) AS score FROM ms m LEFT JOIN ps p USING (user_id, week, item) WINDOW g AS (PARTITION BY user_id, week)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY round_even(score, 9) DESC, item) AS rank FROM sc)"""


def _targets(spark, sf_dir):
    """(history, targets of a week) of rolling rankings."""
    events = table(spark, sf_dir, "events").withColumns({"us": micros("ts"), "role": F.col("user_id") % 5, "version": F.col("event_id") % 4})
    weekly = events.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("user_id", "role", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"))
    targets = weekly.agg(F.min("us").alias("us"), F.min_by("version", F.struct("ts", "event_id")).alias("version"), F.collect_set("event_type").alias("actual"))
    return events, targets.withColumn("key", F.struct("user_id", "week"))


def _rolling(spark, sf_dir):
    events, targets = _targets(spark, sf_dir)
    ranked = rolling.rolling_scores(events, targets, "key", "role", "user_id", "event_type", "version", "us", 0.7, 0.15, 1_704_067_200_000_000, frame_days=10)
    return targets, ranked


@plans.query("rolling_rankings", f"WITH {_SCORES} SELECT user_id, week::TIMESTAMP AS week, item, round_even(score, 7) AS score, rank::INT AS rank FROM rk")
def rolling_rankings(spark, sf_dir):
    return _rolling(spark, sf_dir)[1].select("key.user_id", "key.week", F.col("event_type").alias("item"), rounded("score", 7).alias("score"), "rank")


@plans.query("rolling_tuning", f"""WITH {_TARGETS}, hi AS (SELECT *, user_id % 5 AS role, event_id % 4 AS version FROM events),
ms AS (SELECT t.user_id, t.week, h.event_type AS item, sum({_W}) AS a, coalesce(sum(CASE WHEN h.version = t.version THEN {_W} END), 0) AS s FROM tt t JOIN hi h ON h.role = t.role AND h.ts < t.start AND h.ts >= t.start - INTERVAL 10 DAY GROUP BY ALL),
ps AS (SELECT t.user_id, t.week, h.event_type AS item, sum({_W}) AS w FROM tt t JOIN hi h ON h.user_id = t.user_id AND h.ts < t.start AND h.ts >= t.start - INTERVAL 10 DAY GROUP BY ALL),
tr AS (SELECT mw, ow, row_number() OVER () AS n FROM (SELECT unnest([0.5, 0.7, 0.85, 0.95, 1.0]::DOUBLE[]) AS mw), (SELECT unnest([0.05, 0.15, 0.3]::DOUBLE[]) AS ow)),
sc AS (SELECT mw, ow, user_id, week, item, mw * ((ow * a + (1 - ow) * s) / sum(ow * a + (1 - ow) * s) OVER g) + (1 - mw) * coalesce(p.w / sum(p.w) OVER g, 0) AS score FROM ms LEFT JOIN ps p USING (user_id, week, item), tr WINDOW g AS (PARTITION BY mw, ow, user_id, week)),
rk AS (SELECT *, row_number() OVER (PARTITION BY mw, ow, user_id, week ORDER BY round_even(score, 9) DESC, item) AS r FROM sc), ht AS (SELECT mw, ow, user_id, week, max((r = 1 AND list_contains(actual, item))::INT) AS h1, max((r <= 3 AND list_contains(actual, item))::INT) AS h3 FROM rk JOIN tt USING (user_id, week) GROUP BY ALL),
su AS (SELECT mw AS meta_weight, ow AS off_version, count(*) AS targets, round_even(avg(h1), 4) AS hit_1, round_even(avg(h3), 4) AS hit_3 FROM ht GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY hit_3 DESC, hit_1 DESC, meta_weight, off_version)::INT AS place FROM su""")
def rolling_tuning(spark, sf_dir):
    """All fifteen pairs of weights of the rolling rankings, best first."""
    events, targets = _targets(spark, sf_dir)
    parts = rolling.rolling_parts(events, targets, "key", "role", "user_id", "event_type", "version", "us", 1_704_067_200_000_000, frame_days=10)
    return rolling.tuned(parts, targets, "key", "event_type", "actual")


@plans.query("rolling_hits", f"""WITH {_SCORES}, be AS (SELECT user_id, week, list(item ORDER BY rank) AS predicted FROM rk WHERE rank <= 3 GROUP BY ALL)
SELECT user_id, week::TIMESTAMP AS week, array_to_string(predicted, ',') AS predicted, list_contains(actual, predicted[1]) AS hit_1, len(list_intersect(predicted, actual)) > 0 AS hit_3 FROM be JOIN tt USING (user_id, week)""")
def rolling_hits(spark, sf_dir):
    targets, ranked = _rolling(spark, sf_dir)
    return rolling.hits(ranked, targets, "key", "event_type", "actual").select("key.user_id", "key.week", F.array_join("predicted", ",").alias("predicted"), "hit_1", "hit_3")


_BAN_X = ["meta_rate", "team_rate", "comfort", "surprise", "first_ban", "previous"]


def _step(k: int) -> str:
    """SQL of a weight after a step; k is 1 for the intercept, and the baseline's fits have zeros for what they leave out."""
    x = "1" if k == 1 else f"CASE WHEN extended OR {k} <= 4 THEN x[{k - 1}] ELSE 0 END"
    ridge = "" if k == 1 else f" + 0.01 * any_value(w)[{k}]"
    return f"any_value(w)[{k}] - 0.08 * (avg((p - y) * {x}){ridge})"


_LOGIT = "w[1] + " + " + ".join(f"w[{k}] * x[{k - 1}]" for k in range(2, 8))
_BANS = f"""WITH RECURSIVE {_ACTIONS.replace('sg AS (', 'sg AS MATERIALIZED (', 1)}, tm AS (SELECT ac.*, 'l' || (user_id % 3) AS league, 't' || user_id || CASE WHEN side = 'Blue' THEN 'a' ELSE 'b' END AS team, 't' || user_id || CASE WHEN side = 'Blue' THEN 'b' ELSE 'a' END AS opponent FROM ac),
bn AS (SELECT *, count(*) OVER (PARTITION BY league {{o}}) AS ln, count(*) OVER (PARTITION BY league, champion {{o}}) AS lh, count(*) OVER (PARTITION BY team {{o}}) AS bt, count(*) OVER (PARTITION BY team, champion {{o}}) AS bh, count(*) OVER (PARTITION BY team, opponent, champion {{o}}) AS previous FROM tm WHERE action_type = 'ban'),
un AS (SELECT team AS k, champion, date, gameid, action_number, 1 AS pick FROM tm WHERE action_type = 'pick' UNION ALL SELECT opponent, champion, date, gameid, action_number, 0 FROM tm WHERE action_type = 'ban'),
tp AS (SELECT *, coalesce(sum(pick) OVER (PARTITION BY k {{o}}), 0) AS pn, coalesce(sum(pick) OVER (PARTITION BY k, champion {{o}}), 0) AS ph FROM un),
ra AS (SELECT bn.*, (lh + 2 * e) / (ln + 2) AS meta_rate, (bh + 2 * ((lh + 2 * e) / (ln + 2))) / (bt + 2) AS team_rate, (ph + 2 * e) / (pn + 2) AS comfort FROM bn JOIN tp ON tp.pick = 0 AND tp.gameid = bn.gameid AND tp.action_number = bn.action_number, (SELECT 1.0::DOUBLE / count(DISTINCT champion) AS e FROM tm)),
ev AS (SELECT *, -ln(greatest(0.60 * meta_rate + 0.25 * team_rate + 0.15 * comfort, 1e-9)) AS surprise, (previous = 0)::INT::DOUBLE AS first_ban, EXISTS (SELECT 1 FROM tm p WHERE p.action_type = 'pick' AND p.team = ra.opponent AND p.champion = ra.champion AND p.date > ra.date AND p.date <= ra.date + INTERVAL 14 DAY AND p.series_id = ra.series_id) AS same_series,
 EXISTS (SELECT 1 FROM tm p WHERE p.action_type = 'pick' AND p.team = ra.opponent AND p.champion = ra.champion AND p.date > ra.date AND p.date <= ra.date + INTERVAL 14 DAY AND p.series_id <> ra.series_id) AS next_series FROM ra)""".replace("{o}", "ORDER BY date, gameid, action_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")


def _ban_events(spark, sf_dir):
    """Bans with features and outcomes, from all actions in order of their games."""
    df = seq.draft_actions(games(spark, sf_dir))
    blue = F.col("side") == "Blue"
    user = F.floor(F.col("gameid") / 100000)
    teams = {"team": F.when(blue, F.col("blue_team")).otherwise(F.col("red_team")), "opponent": F.when(blue, F.col("red_team")).otherwise(F.col("blue_team"))}
    actions = df.withColumns({**teams, "league": F.concat(F.lit("l"), user % 3), "time": F.unix_micros("date")}).select("gameid", "series_id", "action_number", "action_type", "league", "team", "opponent", F.col("champion").alias("item"), "time")
    # counts, outcomes and the number of items all read the actions
    actions = stored(actions.withColumn("action_id", F.col("gameid") * 20 + F.col("action_number") - 1), "actions")
    bans = banstudy.ban_events(actions, ["time", "gameid", "action_number"], F.floor(F.col("time") / 86_400_000_000))
    return banstudy.outcomes(bans, actions, "time", "series_id", "action_id")


@plans.query("ban_events", f"""{_BANS} SELECT gameid * 20 + action_number - 1 AS action_id, {', '.join(f'round_even({c}, 9) AS {c}' for c in _BAN_X[:4])}, previous, same_series, next_series, same_series OR next_series AS within_days FROM ev""")
def ban_events(spark, sf_dir):
    found = _ban_events(spark, sf_dir)
    return found.select("action_id", *(rounded(c, 9).alias(c) for c in _BAN_X[:4]), F.col("previous_matchup_bans").alias("previous"), *((F.col(c) > 0).alias(c) for c in banstudy.OUTCOMES))


@plans.query("ban_study", f"""{_BANS}, lo AS (SELECT date, league, [{', '.join(f'{c}::DOUBLE' for c in _BAN_X)}] AS x, unnest(['same_series', 'next_series', 'within_days']) AS outcome, unnest([same_series::INT, next_series::INT, (same_series OR next_series)::INT])::DOUBLE AS y FROM ev),
tr2 AS MATERIALIZED (SELECT outcome, y, x, unnest([true, false]) AS extended FROM lo WHERE date < '{_CUTOFF}'),
wt(i, outcome, extended, w) AS (SELECT 0, outcome, extended, [0, 0, 0, 0, 0, 0, 0]::DOUBLE[] FROM (SELECT DISTINCT outcome, extended FROM tr2) UNION ALL
 SELECT i + 1, outcome, extended, [{', '.join(_step(k) for k in range(1, 8))}]::DOUBLE[] FROM (SELECT wt.*, y, x, 1 / (1 + exp(-least(30.0, greatest(-30.0, {_LOGIT})))) AS p FROM wt JOIN tr2 USING (outcome, extended) WHERE i < 400) GROUP BY i, outcome, extended),
te AS (SELECT outcome, extended, y, least(1 - 1e-9, greatest(1e-9, 1 / (1 + exp(-least(30.0, greatest(-30.0, {_LOGIT})))))) AS q FROM lo JOIN (SELECT * FROM wt WHERE i = 400) USING (outcome) WHERE date >= '{_CUTOFF}' AND league IN ('l0', 'l1')),
me AS (SELECT outcome, extended, count(*) AS rows, sum(y)::BIGINT AS positives, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS l, avg(pow(q - y, 2)) AS b FROM te GROUP BY ALL)
SELECT outcome, x.rows, x.positives, round_even(x.l, 7) AS baseline_log_loss, round_even(x.b, 7) AS baseline_brier, round_even(z.l, 7) AS extended_log_loss, round_even(z.b, 7) AS extended_brier, round_even(x.l - z.l, 7) AS delta_log_loss, round_even(x.b - z.b, 7) AS delta_brier FROM me x JOIN me z USING (outcome) WHERE NOT x.extended AND z.extended""")
def ban_study(spark, sf_dir):
    """Six fits on earlier bans, judged on later ones: each outcome without and with the features of the ban itself."""
    events = stored(_ban_events(spark, sf_dir), "bans")
    later = F.col("time") >= F.unix_micros(F.lit(_CUTOFF).cast("timestamp"))
    report = banstudy.evaluate(events.where(~later), events.where(later & F.col("league").isin("l0", "l1")))
    return report.select("outcome", "rows", "positives", *(rounded(c, 7).alias(c) for c in report.columns if c.endswith(("log_loss", "brier"))))


# What each item multiplies points by.
_MULTIPLIERS = {"click": 1.3, "error": 1.4, "purchase": 1.5, "signup": 1.6, "view": 1.7}
_PATCH = "'15.' || (1 + ({}::DATE - DATE '2024-01-01') // 6)"


def _expected(source: str, number: int) -> str:
    """SQL of a round of teammates' expectations."""
    return f"""x{number} AS (SELECT c.team, c.player, c.week, c.item, any_value(c.p0) AS p0, least(0.35, coalesce(sum(bw.boost * m.p), 0)) AS s FROM {source} c LEFT JOIN bw ON bw.week = c.week AND bw.a = c.item LEFT JOIN {source} m ON m.team = c.team AND m.week = c.week AND m.player <> c.player AND m.item = bw.b GROUP BY c.team, c.player, c.week, c.item),
c{number} AS (SELECT team, player, week, item, p0, p0 * (1 + s) / sum(p0 * (1 + s)) OVER (PARTITION BY team, player, week) AS p FROM x{number})"""


_PRE_METRICS = ["targets", "top1", "top3", "realized"]
_CASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _MULTIPLIERS.items())


@plans.query("predraft_ablation", f"""WITH {_SCORES}, pi AS (SELECT DISTINCT user_id % 30 AS team, ts::DATE AS day, {_PATCH.format('ts')} AS patch, event_type AS item FROM events), wk AS (SELECT DISTINCT week, 1 + (week::DATE - DATE '2024-01-01') // 6 AS tn FROM tt),
ga AS (SELECT week, patch, item, count(*) AS g FROM wk JOIN pi ON day < week GROUP BY ALL), pp AS (SELECT week, tn, x.patch, x.item AS a, y.item AS b, count(*) AS n FROM wk JOIN pi x ON x.day < week JOIN pi y ON x.team = y.team AND x.day = y.day AND x.item < y.item GROUP BY ALL),
bo AS (SELECT pp.week, tn, a, b, split_part(pp.patch, '.', 2)::INT AS hn, least(0.25, n::DOUBLE / least(p.g, q.g) * n / (n + 8)) AS boost FROM pp JOIN ga p ON p.week = pp.week AND p.patch = pp.patch AND p.item = a JOIN ga q ON q.week = pp.week AND q.patch = pp.patch AND q.item = b WHERE n >= 3),
bs AS (SELECT week, a, b, least(0.25, avg(boost * exp(-0.15 * (tn - hn)))) AS boost FROM bo WHERE hn <= tn AND tn - hn <= 4 GROUP BY ALL), bw AS (SELECT week, a, b, boost FROM bs UNION ALL SELECT week, b, a, boost FROM bs),
c0 AS (SELECT user_id % 30 AS team, user_id AS player, week, item, score AS p0, score AS p FROM rk WHERE (user_id % 30, week) IN (SELECT (team, week) FROM (SELECT DISTINCT user_id % 30 AS team, week, user_id FROM rk) GROUP BY team, week HAVING count(*) >= 2)), {_expected('c0', 1)}, {_expected('c1', 2)},
al AS (SELECT 'without' AS variant, player, week, item, p0 AS p FROM c0 UNION ALL SELECT 'with', player, week, item, p FROM c2), ra AS (SELECT *, CASE item {_CASES} END AS mu, row_number() OVER (PARTITION BY variant, player, week ORDER BY round_even(p, 9) DESC, item) AS r FROM al),
va AS (SELECT *, row_number() OVER (PARTITION BY variant, player, week ORDER BY round_even(p * (mu - 1), 9) DESC, round_even(p, 9) DESC, item) AS v FROM ra),
pl AS (SELECT user_id AS player, date_trunc('week', ts) AS week, event_type AS item, sum(value) AS points, count(*) AS n FROM events GROUP BY ALL), gm AS (SELECT player, week, sum(n) AS games FROM pl GROUP BY ALL),
pe AS (SELECT variant, va.player, va.week, max((r = 1 AND list_contains(actual, va.item))::INT) AS hit1, max((r <= 3 AND list_contains(actual, va.item))::INT) AS hit3, sum(CASE WHEN v = 1 THEN coalesce(points, 0) * (mu - 1) / games ELSE 0 END) AS realized FROM va JOIN tt ON tt.user_id = va.player AND tt.week = va.week JOIN gm ON gm.player = va.player AND gm.week = va.week LEFT JOIN pl ON pl.player = va.player AND pl.week = va.week AND pl.item = va.item GROUP BY ALL),
mt AS (SELECT variant, count(*)::DOUBLE AS targets, avg(hit1) AS top1, avg(hit3) AS top3, avg(realized) AS realized FROM pe GROUP BY 1)
SELECT variant, {', '.join(f'round_even({c}, 6) AS {c}' for c in _PRE_METRICS)} FROM (SELECT * FROM mt UNION ALL SELECT 'difference', {', '.join(f'x.{c} - y.{c}' for c in _PRE_METRICS)} FROM mt x, mt y WHERE x.variant = 'with' AND y.variant = 'without')""")
def predraft_ablation(spark, sf_dir):
    """What teammates' likely items, through pair strengths known before the week, add to rankings made before a draft."""
    from driftline.operators import ranking

    targets, ranked = _rolling(spark, sf_dir)
    events = table(spark, sf_dir, "events")
    patch = lambda day: F.concat(F.lit("15."), F.floor(F.datediff(day, F.lit("2024-01-01")) / 6) + 1)
    picks = events.select(F.to_date("ts").alias("day"), F.concat_ws("-", F.col("user_id") % 30, F.to_date("ts")).alias("group"), "event_type").distinct()
    picks = picks.select("group", "event_type", F.unix_micros(F.col("day").cast("timestamp")).alias("time"), patch(F.col("day")).alias("version"))
    weeks = targets.select("week").distinct().select(F.unix_micros(F.col("week").cast("timestamp")).alias("week"), patch(F.col("week")).alias("target"))
    items = picks.select(F.col("event_type").alias("a")).distinct()
    wanted = items.join(items.withColumnRenamed("a", "b"), F.col("a") < F.col("b")).join(weeks)
    strength = walkforward.pair_strength(picks, "group", "event_type", "time")(wanted).drop("target")
    df = ranked.select((F.col("key.user_id") % 30).alias("team"), F.col("key.user_id").alias("player"), F.unix_micros(F.col("key.week").cast("timestamp")).alias("week"), F.col("event_type"), F.col("score").alias("p0"))
    several = df.groupBy("team", "week").agg(F.count_distinct("player").alias("players")).where("players >= 2")
    df = stored(df.join(several, ["team", "week"], "left_semi"), "rankings")
    raised = stored(ranking.teammate_synergy(df, stored(strength, "strength"), ["team", "week"], "player", "event_type", "p0", pair_keys=("week",)), "raised")
    multiplier = F.create_map(*(F.lit(x) for pair in _MULTIPLIERS.items() for x in pair))[F.col("event_type")]
    played = events.select(F.col("user_id").alias("player"), F.unix_micros(F.date_trunc("week", "ts").cast("timestamp")).alias("week"), "event_type", "value")
    games = played.groupBy("player", "week").agg(F.count("*").alias("games"))
    actual = targets.select(F.struct("user_id", F.unix_micros(F.col("week").cast("timestamp")).alias("week")).alias("key"), "actual")
    found = []
    for frame, p in ((raised, "p"), (df, "p0")):
        c = frame.select(F.struct(F.col("player").alias("user_id"), "week").alias("key"), "player", "week", "event_type", F.col(p).alias("p"), multiplier.alias("mu")).withColumn("bonus", F.col("p") * (F.col("mu") - 1))
        order = Window.partitionBy("key").orderBy(F.bround("p", 9).desc(), "event_type")
        hits = rolling.hits(c.withColumn("rank", F.row_number().over(order)), actual, "key", "event_type", "actual")
        choice = rolling.value_choices(c, ["player", "week"], "event_type", "p", "bonus", ["mu"]).join(games, ["player", "week"])
        worth = rolling.realized_bonus(choice, played, ["player", "week"], "event_type", "value", "games", "mu")
        both = hits.select("key.user_id", "key.week", "hit_1", "hit_3").join(worth.select(F.col("player").alias("user_id"), "week", "realized"), ["user_id", "week"])
        found.append(rolling.summary(both, [], {"top1": F.col("hit_1"), "top3": F.col("hit_3"), "realized": F.col("realized")}, 12))
    return walkforward.deltas(*found, _PRE_METRICS)


@plans.query("ban_discount", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, event_type, n::DOUBLE / (sum(n) OVER (PARTITION BY user_id))::DOUBLE AS pr FROM c),
d AS (SELECT user_id, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1), r AS (SELECT user_id, event_type, nd::DOUBLE / days AS rate FROM (SELECT user_id, event_type, count(DISTINCT ts::DATE) AS nd FROM events WHERE event_id % 2 = 0 GROUP BY ALL) JOIN d USING (user_id))
SELECT user_id, event_type, round_even(pr * (1 - 0.60 * coalesce(rate, 0)), 8) AS adjusted FROM p LEFT JOIN r USING (user_id, event_type)""")
def ban_discount(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    shares = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    shares = shares.select(F.col("user_id").alias("key"), "user_id", "event_type", (F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("probability"))
    days = events.groupBy("user_id").agg(F.count_distinct("day").alias("days"))
    rates = events.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.count_distinct("day").alias("d")).join(days, "user_id").select("user_id", "event_type", (F.col("d") / F.col("days")).alias("rate"))
    return rolling.ban_discount(shares, rates, "key", "user_id", "event_type").select("user_id", "event_type", rounded("adjusted", 8).alias("adjusted"))
