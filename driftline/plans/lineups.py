"""Line-up query: of the parts a customer bought in a year, one of each type within a budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import lineup
from driftline.plans.base import Plans, stored, table

plans = Plans()
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_MARKET = "(SELECT DISTINCT o_custkey AS customer, year(o_orderdate) AS season, p_type AS slot, p_brand AS grp, p_retailprice - 880 AS cost, p_size::DOUBLE AS value, p_partkey AS item FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"
_JOINS = " ".join(f"JOIN m s{n} ON s{n}.customer = s0.customer AND s{n}.season = s0.season AND s{n}.slot = '{t}'" for n, t in enumerate(TYPES) if n)


@plans.query("lineup_topk", f"""
WITH m AS {_MARKET}, l AS (SELECT s0.customer, s0.season, concat_ws('-', {', '.join(f's{n}.item' for n in range(6))}) AS items, {' + '.join(f's{n}.cost' for n in range(6))} AS cost, {' + '.join(f's{n}.value' for n in range(6))} AS base,
 len(list_distinct([{', '.join(f's{n}.grp' for n in range(6))}])) AS groups, {', '.join(f's{n}.item AS i{n}' for n in range(6))} FROM m s0 {_JOINS} WHERE s0.slot = '{TYPES[0]}')
SELECT customer, season, items, round_even(cost, 2) AS cost, round_even(base, 2) AS base, total, groups FROM (SELECT *, round_even(base * (1 + CASE WHEN groups >= 6 THEN 0.25 WHEN groups >= 5 THEN 0.10 ELSE 0 END), 2) AS total FROM l WHERE cost <= 420 + 1e-9)
QUALIFY row_number() OVER (PARTITION BY customer, season ORDER BY total DESC, round_even(base, 2) DESC, round_even(cost, 2), i0, i1, i2, i3, i4, i5) <= 3""")
def lineup_topk(spark, sf_dir):
    best = lineup.optimize(_items(spark, sf_dir), TYPES, "slot", "grp", "cost", "value", "item", 420.0, {5: 0.10, 6: 0.25}, 3, market=["customer", "season"], store=lambda x: stored(x, "markets"))
    return best.select("customer", "season", F.concat_ws("-", *(F.col(f"item{n}").cast("string") for n in range(6))).alias("items"), "cost", "base", "total", F.col("groups").cast("long").alias("groups"))


def _items(spark, sf_dir):
    """The parts of a customer and year, one row each, dealt by customer, so that markets need no other deal."""
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return bought.select(F.col("o_custkey").alias("customer"), F.year("o_orderdate").cast("long").alias("season"), F.col("p_type").alias("slot"), F.col("p_brand").alias("grp"), (F.col("p_retailprice") - 880).alias("cost"), F.col("p_size").cast("double").alias("value"), F.col("p_partkey").alias("item")).repartition("customer").distinct()


#: Slots of half risk, and what two items of opposing brands cost.
_WEIGHTS, _PENALTY = {"ECONOMY": 0.5}, 5.0
_CONFLICT = " + ".join(f"CASE WHEN s{a}.opp = s{b}.grp OR s{b}.opp = s{a}.grp THEN {round(_PENALTY * min(_WEIGHTS.get(TYPES[a], 1.0), _WEIGHTS.get(TYPES[b], 1.0)), 2)} ELSE 0 END" for a in range(6) for b in range(a + 1, 6))
#: A bonus of the item's cheapest line, worth more the smaller its quantity; a brand's opponent is the next one.
_BEST = f"""bo AS (SELECT o_custkey AS customer, year(o_orderdate) AS season, l_partkey AS item, arg_min(round_even(l_discount * 100, 2), (l_quantity, -l_discount, l_returnflag)) AS bonus FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
m AS (SELECT x.*, value + bonus AS worth, 'Brand#' || (substr(grp, 7)::INT % 25 + 1) AS opp FROM {_MARKET} x JOIN bo USING (customer, season, item)),
l AS (SELECT s0.customer, s0.season, {', '.join(f's{n}.item AS i{n}' for n in range(6))}, {' + '.join(f's{n}.cost' for n in range(6))} AS cost, {' + '.join(f's{n}.worth' for n in range(6))} AS base, len(list_distinct([{', '.join(f's{n}.grp' for n in range(6))}])) AS groups, {_CONFLICT} AS conflict FROM m s0 {_JOINS} WHERE s0.slot = '{TYPES[0]}'),
t AS (SELECT *, round_even(base * (1 + CASE WHEN groups >= 6 THEN 0.25 WHEN groups >= 5 THEN 0.10 ELSE 0 END), 2) AS total FROM l WHERE cost <= 420 + 1e-9),
b AS (SELECT *, round_even(total - conflict, 2) AS score, row_number() OVER (PARTITION BY customer, season ORDER BY round_even(total - conflict, 2) DESC, total DESC, round_even(base, 2) DESC, round_even(cost, 2), i0, i1, i2, i3, i4, i5) AS rank FROM t QUALIFY rank <= 2)"""


def _with_conflicts(spark, sf_dir):
    """(items of markets that have line-ups, the two best line-ups of these with bonus and opponent)."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    options = lines.select(F.col("o_custkey").cast("string").alias("customer"), F.year("o_orderdate").cast("string").alias("season"), F.col("l_partkey").cast("string").alias("part"), F.struct("l_quantity", -F.col("l_discount"), "l_returnflag").alias("place"), F.bround(F.col("l_discount") * 100, 2).alias("bonus"), F.col("l_returnflag").alias("option"))
    items = stored(lineup.complete(_items(spark, sf_dir), ["customer", "season"], TYPES, "slot"), "items")
    keyed = items.withColumn("part", F.col("item").cast("string")).withColumns({c: F.col(c).cast("string") for c in ("customer", "season")})
    keyed = lineup.with_bonus(keyed, options, ["customer", "season", "part"], "place", "bonus", "option")
    opposing = F.concat(F.lit("Brand#"), F.substring("grp", 7, 9).cast("int") % 25 + 1)
    players = keyed.withColumns({"customer": F.col("customer").cast("long"), "season": F.col("season").cast("long"), "worth": F.col("value") + F.col("bonus"), "opponents": F.array(opposing)}).drop("part")
    best = lineup.optimize(players, TYPES, "slot", "grp", "cost", "worth", "item", 420.0, {5: 0.10, 6: 0.25}, 2, "opponents", _PENALTY, ["customer", "season"], _WEIGHTS, lambda x: stored(x, "markets"))
    return items, best


@plans.query("lineup_conflicts", f"WITH {_BEST} SELECT customer, season, rank::INT AS rank, concat_ws('-', i0, i1, i2, i3, i4, i5) AS items, round_even(cost, 2) AS cost, round_even(base, 2) AS base, groups, total, round_even(conflict::DOUBLE, 2) AS conflict, score AS rank_score FROM b")
def lineup_conflicts(spark, sf_dir):
    """Line-ups of items with the bonus of their first option, less what opposing items cost."""
    _, best = _with_conflicts(spark, sf_dir)
    return best.select("customer", "season", "rank", F.concat_ws("-", *(F.col(f"item{n}").cast("string") for n in range(6))).alias("items"), "cost", "base", F.col("groups").cast("long").alias("groups"), "total", "conflict", "rank_score")


@plans.query("lineup_documents", f"""WITH {_BEST}, u AS (SELECT customer, season, rank, n, (['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'])[n] AS slot, [i0, i1, i2, i3, i4, i5][n] AS item FROM b, range(1, 7) r(n)),
op AS (SELECT o_custkey AS customer, year(o_orderdate) AS season, l_partkey AS item, string_agg(l_returnflag || ':' || l_quantity::INT, ',' ORDER BY l_quantity, l_returnflag) AS options FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT customer, season, string_agg(text, '|' ORDER BY rank) AS lineups FROM (SELECT customer, season, rank, rank || '/' || any_value(score)::DECIMAL(12, 2) || '/' || string_agg(u.slot || '=' || item || '@' || grp || '[' || options || ']', ';' ORDER BY n) AS text FROM u JOIN m USING (customer, season, slot, item) JOIN op USING (customer, season, item) JOIN (SELECT customer, season, rank, score FROM b) USING (customer, season, rank) GROUP BY customer, season, rank) GROUP BY ALL""")
def lineup_documents(spark, sf_dir):
    """One stored document a market, read back: its line-ups, their items and each item's options."""
    items, best = _with_conflicts(spark, sf_dir)
    best = stored(best, "best")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    options = lines.select(F.col("o_custkey").alias("customer"), F.year("o_orderdate").cast("long").alias("season"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_returnflag").alias("flag"))
    found = lineup.documents(best, TYPES, items, ["customer", "season"], "slot", "item", ["grp"], options, ["quantity", "flag"], F.struct("flag", "quantity"))
    shape = "struct<lineups:array<struct<rank:int,rank_score:decimal(12,2),items:array<struct<slot:string,item:long,grp:string,options:array<struct<flag:string,quantity:int>>>>>>>"
    read = found.select("customer", "season", F.from_json("document", shape).alias("d"))
    options_text = lambda i: F.array_join(F.transform(i["options"], lambda o: F.concat(o["flag"], F.lit(":"), o["quantity"])), ",")
    items_text = lambda x: F.array_join(F.transform(x["items"], lambda i: F.concat(i["slot"], F.lit("="), i["item"], F.lit("@"), i["grp"], F.lit("["), options_text(i), F.lit("]"))), ";")
    text = F.transform("d.lineups", lambda x: F.concat(x["rank"], F.lit("/"), x["rank_score"].cast("string"), F.lit("/"), items_text(x)))
    return read.select("customer", "season", F.array_join(text, "|").alias("lineups"))
