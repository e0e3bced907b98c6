"""Sequential folds: price paths, ratings and counters before each event."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.numbers import half_even


@dataclass(frozen=True)
class Market:
    """How a price follows scores; above each damping price a rise counts by its factor."""

    start: float = 15.0
    neutral: float = 13.0
    rate: float = 0.2
    floor: float = 5.0
    ceiling: float = 32.0
    damping: tuple[tuple[float, float], ...] = ((22.0, 0.5), (26.0, 0.25))
    digits: int = 1


def price_step(price: Column, score: Column, m: Market) -> Column:
    """The price after a week; rises are damped by the price before, falls are not."""
    factor = F.lit(1.0)
    for level, value in m.damping:
        factor = F.when(price >= level, value).otherwise(factor)
    change = F.lit(m.rate) * (score - m.neutral)
    change = F.when(change > 0, change * factor).otherwise(change)
    return F.least(F.lit(m.ceiling), F.greatest(F.lit(m.floor), half_even(price + change, m.digits)))


def price_paths(weeks: DataFrame, entity: str, week: str, period: str, score: str, m: Market = Market()) -> DataFrame:
    """(entity, week, period, price, next_price, reset) of every week; a new period starts again.

    One row of each entity holds its weeks, which are few; all entities run in parallel.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(week).alias("week"), F.col(period).alias("period"), F.col(score).alias("score"))))
    kinds = dict(weeks.dtypes)
    empty = F.array().cast(f"array<struct<week:{kinds[week]},period:{kinds[period]},price:double,next_price:double,reset:boolean>>")

    def step(path, x):
        last = F.try_element_at(path, F.lit(-1))
        reset = last["period"].isNull() | (last["period"] != x["period"])
        price = F.when(reset, F.lit(m.start)).otherwise(last["next_price"])
        return F.concat(path, F.array(F.struct(x["week"].alias("week"), x["period"].alias("period"), price.alias("price"), price_step(price, x["score"], m).alias("next_price"), reset.alias("reset"))))

    paths = weeks.groupBy(entity).agg(F.aggregate(items, empty, step).alias("path"))
    return paths.select(entity, F.explode("path").alias("x")).select(entity, "x.*")


def expected(a: float, b: float) -> float:
    return 1 / (1 + 10 ** ((b - a) / 400))


def elo(matches: DataFrame, pool: str, order: list[str], k: float = 32.0, base: float = 1500.0) -> DataFrame:
    """Ratings before each match (side_a, side_b, a_win) of each pool.

    Ratings depend on all matches before, so a pool runs in order in one task; pools run
    in parallel.  Matches stream through in sorted batches of six columns, and a task keeps
    one rating for each side of the pool it is in.
    """

    def run(batches):
        name, ratings = None, {}
        for pdf in batches:
            out = []
            for p, a, b, win in zip(pdf[pool], pdf["side_a"], pdf["side_b"], pdf["a_win"], strict=True):
                if p != name:
                    name, ratings = p, {}
                ra, rb = ratings.get(a, base), ratings.get(b, base)
                chance = expected(ra, rb)
                out.append((ra, rb, chance))
                ratings[a], ratings[b] = ra + k * (win - chance), rb - k * (win - chance)
            pdf[["rating_a", "rating_b", "p_a"]] = pd.DataFrame(out, columns=["rating_a", "rating_b", "p_a"], dtype=float).to_numpy()
            yield pdf

    columns = list(dict.fromkeys([pool, *order, "side_a", "side_b", "a_win"]))
    kinds = dict(matches.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["rating_a double", "rating_b double", "p_a double"])
    ordered = matches.select(*columns).repartition(pool).sortWithinPartitions(pool, *order)
    return ordered.mapInPandas(run, schema)


def counters(df: DataFrame, order: list[str], groups: dict[str, list[str]], hot: dict[str, list[str]] | None = None, bucket: Column | None = None) -> DataFrame:
    """Adds, for each name, the earlier rows of the same keys.

    Names in ``hot`` have few keys or none: their rows are counted inside buckets of
    time (a column that never falls along the order), and the totals of a key's earlier
    buckets, which are few rows, are added.
    """
    for n, keys in (hot or {}).items():
        df = df.withColumn("_bucket", bucket)
        inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        sizes = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
        # a key without columns has one total a bucket; all of them fit in one window
        earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
        at = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*keys, "_bucket"]]
        met = df.withColumn("_inside", F.count("*").over(inside)).alias("x").join(sizes.alias("y"), at)
        df = met.select("x.*", (F.col("_inside") + F.col("_before")).alias(n)).drop("_inside", "_bucket")
    return df.withColumns({n: F.count("*").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)) for n, keys in groups.items()})


def smoothed(successes: Column, n: Column, prior: Column | float) -> Column:
    prior = F.lit(prior) if isinstance(prior, float) else prior
    return (successes + 2 * prior) / (n + 2)


def latest_capture(df: DataFrame, keys: list[str], captured: str) -> DataFrame:
    """The last captured row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(captured).desc()))).where("_r = 1").drop("_r")


def official_prices(modeled: DataFrame, official: DataFrame, keys: list[str]) -> DataFrame:
    """Modeled prices, with official ones in their place where there are any."""
    merged = modeled.join(official.select(*keys, F.col("price").alias("_official")), keys, "full")
    return merged.withColumns({"price": F.coalesce("_official", "price"), "source": F.when(F.col("_official").isNotNull(), "official").otherwise("modeled")}).drop("_official")
