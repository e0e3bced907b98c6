"""Models whose sums are Spark aggregates, and their evaluation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_chances(train: DataFrame, targets: DataFrame, features: list[str], label: str, weight: Column | None = None, alpha: float = 1.0, name: str = "chances") -> DataFrame:
    """Targets with a list of (label, probability) of every label, in order of labels: smoothed weighted counts of categorical features; an unseen value adds one to the values' number.

    A value's terms of all labels are one list and meet the targets so: a target stays one row and not one a label and feature.
    """
    known = train.where(F.col(label).isNotNull()).select(F.col(label).alias("_label"), *features, (F.lit(1.0) if weight is None else weight).alias("_w"))
    classes = F.array_sort(F.collect_list(F.struct("_label", "class_w")))
    one = known.groupBy("_label").agg(F.sum("_w").alias("class_w")).agg(classes.alias("_classes"), F.sum("class_w").alias("_total"))
    out, lists, unseen = targets, [], []

    def terms_of(count: Callable[[Column], Column], values: Column) -> Column:
        return F.transform("_classes", lambda c: F.log((count(c["_label"]) + alpha) / (c["class_w"] + alpha * values)))

    for i, feature in enumerate(features):
        counts = known.where(F.col(feature).isNotNull()).groupBy(feature, "_label").agg(F.sum("_w").alias("_n"))
        seen = counts.groupBy(F.col(feature).alias(f"_value{i}")).agg(F.map_from_entries(F.collect_list(F.struct("_label", "_n"))).alias("_of"))
        sizes = seen.agg(F.count("*").alias(f"_size{i}"))
        terms = terms_of(lambda name: F.coalesce(F.col("_of")[name], F.lit(0.0)), F.col(f"_size{i}"))
        value = seen.crossJoin(one.select("_classes")).crossJoin(sizes).select(f"_value{i}", terms.alias(f"_terms{i}"))
        out = out.join(value, F.col(feature) == F.col(f"_value{i}"), "left")
        one = one.crossJoin(sizes)
        unseen.append(terms_of(lambda name: F.lit(0.0), F.col(f"_size{i}") + 1).alias(f"_unseen{i}"))
        lists.append((f"_terms{i}", f"_unseen{i}"))
    out = out.crossJoin(one.select("_classes", "_total", *unseen))

    def log(c: Column, at: Column) -> Column:
        found = F.log((c["class_w"] + alpha) / (F.col("_total") + alpha * F.size("_classes")))
        for terms, none in lists:
            found = found + F.get(F.coalesce(terms, none), at)
        return found

    # lists bound as one entry are made once, though each label needs their greatest value or their sum
    bound = lambda x, use: F.flatten(F.transform(F.array(x), use))
    logs = bound(F.transform("_classes", log), lambda x: F.transform(F.array(F.array_max(x)), lambda most: F.transform(x, lambda v: F.exp(v - most))))
    shares = bound(F.flatten(logs), lambda x: F.transform(F.array(F.aggregate(x, F.lit(0.0), lambda a, v: a + v)), lambda total: F.transform(x, lambda v: v / total)))
    chances = F.zip_with("_classes", F.flatten(shares), lambda c, p: F.struct(c["_label"].alias("label"), p.alias("probability")))
    return out.select(*(F.col(c) for c in targets.columns), chances.alias(name))


def naive_bayes(train: DataFrame, targets: DataFrame, features: list[str], label: str, key: str, weight: Column | None = None, alpha: float = 1.0) -> DataFrame:
    """(key, label, probability) of every label, from smoothed weighted counts of categorical features; an unseen value adds one to the values' number."""
    chances = label_chances(train, targets.select(key, *features), features, label, weight, alpha)
    return chances.select(key, F.explode("chances").alias("_x")).select(key, F.col("_x.label").alias(label), "_x.probability")


def logistic(df: DataFrame, features: list[str], label: str, steps: int = 200, rate: float = 0.1, ridge: float = 0.01, intercept: bool = True) -> np.ndarray:
    """Weights of a logistic regression by gradient steps; each step's gradient is one aggregate over all rows.

    Features are first summed by distinct rows, which keeps steps small where features are few and discrete.
    """
    columns = features + ([] if not intercept else ["_one"])
    rows = df.where(F.col(label).isNotNull()).withColumn("_one", F.lit(1.0)).groupBy(*columns).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("double")).alias("_hits")).persist()
    total = rows.agg(F.sum("_n")).first()[0] or 0
    w = np.zeros(len(columns))
    for _ in range(steps if total else 0):
        z = F.lit(0.0)
        for c, v in zip(columns, w, strict=True):
            z = z + F.lit(float(v)) * F.col(c)
        p = 1 / (1 + F.exp(-F.least(F.lit(10.0), F.greatest(F.lit(-10.0), z))))
        sums = rows.agg(*(F.sum((F.col("_n") * p - F.col("_hits")) * F.col(c)) for c in columns)).first()
        shrink = np.array([ridge] * len(features) + [0.0] * (len(columns) - len(features)))
        w = w - rate * (np.array([float(x) for x in sums]) / total + shrink * w)
    rows.unpersist()
    return w


def blocks(df: DataFrame, columns: list[str], rows: int = 100_000) -> DataFrame:
    """Numeric columns as blocks of 64-bit floats, column after column; rows of a block stay in their task."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                data = b"".join(np.ascontiguousarray(c.to_numpy(zero_copy_only=False), dtype=np.float64).tobytes() for c in part.columns)
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["block"])

    return df.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(run, "block binary")


#: Rows that one task takes in a step; so many or fewer are stepped through in a single task.
TASK_ROWS = 200_000


def logistic_many(df: DataFrame, fits: dict[str, tuple[list[str], str]], steps: int = 400, rate: float = 0.08, ridge: float = 0.01, clip: float = 30.0, start: dict[str, list[float]] | None = None, task_rows: int = TASK_ROWS) -> dict[str, np.ndarray]:
    """Weights (intercept first) of several logistic regressions {name: (features, label)} on the same rows, by full-batch steps.

    One pass a step returns the gradients of all fits: a task's sums are one row of as many numbers as there are weights.
    Rows that fit one task make all steps there, with the same result.
    """
    columns = list(dict.fromkeys(c for features, label in fits.values() for c in (*features, label)))
    # a step's job reads the cached blocks as they are, without planning or converting rows
    data = blocks(df, columns).rdd.map(lambda r: bytes(r["block"])).persist(StorageLevel.MEMORY_AND_DISK)
    names, first = list(fits), start or {}
    weights = {name: np.array(first.get(name, np.zeros(len(features) + 1)), dtype=float) for name, (features, _) in fits.items()}
    # fits of the same features are one product
    shared: dict[tuple[int, ...], list[str]] = {}
    for name, (features, _) in fits.items():
        shared.setdefault(tuple(columns.index(c) for c in features), []).append(name)
    labels = {name: columns.index(label) for name, (_, label) in fits.items()}

    def sums(parts: list[np.ndarray], weights: dict[str, np.ndarray]) -> np.ndarray:
        total, count = {n: np.zeros(len(w)) for n, w in weights.items()}, 0
        for x in parts:
            count += x.shape[1]
            for at, same in shared.items():
                own = x[at[0] : at[-1] + 1] if at and at == tuple(range(at[0], at[-1] + 1)) else x[list(at)]
                w = np.array([weights[n] for n in same])
                error = 1 / (1 + np.exp(-np.clip(w[:, :1] + w[:, 1:] @ own, -clip, clip))) - x[[labels[n] for n in same]]
                for n, found in zip(same, np.column_stack([error.sum(axis=1), error @ own.T]), strict=True):
                    total[n] += found
        return np.concatenate([[count], *total.values()])

    def stepped(weights: dict[str, np.ndarray], found: np.ndarray) -> dict[str, np.ndarray]:
        out, low = {}, 1
        for n in names:
            w = weights[n]
            gradient = found[low : low + len(w)] / max(1.0, found[0])
            gradient[1:] += ridge * w[1:]
            out[n], low = w - rate * gradient, low + len(w)
        return out

    def over(frame: RDD, work) -> list[np.ndarray]:
        """What work makes of each task's blocks."""
        return frame.mapPartitions(lambda found: [work([np.frombuffer(block, dtype=np.float64).reshape(len(columns), -1) for block in found])]).collect()

    def whole(parts):
        w = weights
        for _ in range(steps):
            w = stepped(w, sums(parts, w))
        return np.concatenate(list(w.values()))

    rows = sum(over(data, lambda parts: np.array([sum(x.shape[1] for x in parts)], dtype=float)), np.zeros(1))[0]
    tasks = max(1, -(-int(rows) // task_rows))
    if tasks == 1:
        flat = over(data.coalesce(1), whole)
        ends = np.cumsum([len(w) for w in weights.values()])
        weights = dict(zip(names, np.split(flat[0], ends[:-1]), strict=True)) if flat else weights
    else:
        data = data.coalesce(tasks)
        for _ in range(steps):
            weights = stepped(weights, np.sum(over(data, lambda parts, w=weights: sums(parts, w)), axis=0))
    data.unpersist()
    return weights


def logistic_chance(weights: np.ndarray, features: list[str], clip: float = 30.0) -> Column:
    """The chance that weights (intercept first) give a row."""
    z = F.lit(float(weights[0]))
    for c, w in zip(features, weights[1:], strict=True):
        z = z + F.lit(float(w)) * F.col(c)
    return 1 / (1 + F.exp(-F.least(F.lit(clip), F.greatest(F.lit(-clip), z))))


def conditional_logit(candidates: DataFrame, group: str, features: list[str], chosen: str, start: list[float], steps: int = 10, rate: float = 0.05, ridge: float = 0.01, least: float = 0.001) -> np.ndarray:
    """Weights of a choice among each group's candidates, kept at or above ``least``; a step is one aggregate over all groups."""
    w = np.array(start, dtype=float)
    rows = candidates.persist()
    for _ in range(steps):
        z = F.lit(0.0)
        for c, v in zip(features, w, strict=True):
            z = z + F.lit(float(v)) * F.col(c)
        window = Window.partitionBy(group)
        e = F.exp(F.col("_z") - F.max("_z").over(window))
        p = rows.withColumn("_z", z).withColumn("_p", e / F.sum(e).over(window))
        sums = p.agg(F.count_distinct(group), *(F.sum((F.col(chosen).cast("double") - F.col("_p")) * F.col(c)) for c in features)).first()
        if not sums[0]:
            break
        w = np.maximum(least, w + rate * (np.array([float(x) for x in sums[1:]]) / sums[0] - ridge * w))
    rows.unpersist()
    return w


def ols_slope(x: Column, y: Column) -> Column:
    """Slope without intercept."""
    return F.try_divide(F.sum(x * y), F.sum(x * x))


def metrics(p: Column, y: Column, epsilon: float = 1e-15) -> dict[str, Column]:
    q = F.least(F.lit(1 - epsilon), F.greatest(F.lit(epsilon), p))
    y = y.cast("double")
    return {"rows": F.count("*"), "accuracy": F.avg(((p >= 0.5).cast("double") == y).cast("double")), "log_loss": F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))), "brier": F.avg((p - y) * (p - y))}


def decile(p: Column) -> Column:
    """Ten equal bins, each closed on the left, the last on both sides."""
    return F.least(F.floor(p * 10), F.lit(9)).cast("int")


def equal_bin(p: Column, bins: int) -> Column:
    """Equal bins of (0, 1], each closed on the right."""
    return F.greatest(F.ceil(p * bins) - 1, F.lit(0)).cast("int")


def rank_metrics(ranked: DataFrame, rank: str, probability: str, epsilon: float = 1e-15) -> DataFrame:
    """Top-1, top-5, mean reciprocal rank and log loss over targets; a null rank is an item never offered."""
    r = F.col(rank)
    return ranked.agg(
        F.count("*").alias("targets"), F.avg(F.coalesce((r <= 1).cast("double"), F.lit(0.0))).alias("top1"), F.avg(F.coalesce((r <= 5).cast("double"), F.lit(0.0))).alias("top5"),
        F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"), F.avg(F.when(r.isNotNull(), -F.log(F.greatest(F.col(probability), F.lit(epsilon))))).alias("log_loss"),
    )


def pearson(x: str, y: str) -> Column:
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def available_ranks(probabilities: DataFrame, offered: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, probability, rank) of the labels that are offered to each key (key, label), made to sum to 1 again; the likeliest first, ties by label."""
    met = probabilities.join(offered.select(key, label).distinct(), [key, label])
    window = Window.partitionBy(key)
    out = met.withColumn("probability", F.col("probability") / F.sum("probability").over(window))
    # sums in another order differ in their last digits, which must not settle ties
    return out.withColumn("rank", F.row_number().over(window.orderBy(F.bround("probability", 9).desc(), label)))


def ranked_list(chances: str | Column, offered: Callable[[Column], Column]) -> Column:
    """A list of (label, probability, rank) of the chances whose label is offered: as ``available_ranks``, inside a row."""
    kept = F.transform(F.array(F.filter(chances, lambda x: offered(x["label"]))), lambda x: F.struct(x.alias("x"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v["probability"]).alias("total")))
    scaled = F.flatten(F.transform(kept, lambda k: F.transform(k["x"], lambda v: F.struct((-F.bround(v["probability"] / k["total"], 9)).alias("order"), v["label"].alias("label"), (v["probability"] / k["total"]).alias("probability")))))
    return F.transform(F.array_sort(scaled), lambda v, at: F.struct(v["label"].alias("label"), v["probability"].alias("probability"), (at + 1).alias("rank")))


#: Distinct values that one task orders on average.
RANKED_VALUES = 1_000_000


def average_ranks(df: DataFrame, keys: list[str], column: str, name: str, values: int = RANKED_VALUES) -> DataFrame:
    """Adds the rank of a number inside its keys, ties sharing their mean rank; nulls come first and share theirs.

    Rows are counted by value before anything is ordered.  Values are ordered inside ranges of equal
    width, so that few keys do not mean few tasks, and the ranges' totals, which are few rows, are added.
    """
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    found = counts.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    ranges = max(1, -(-found["n"] // values))
    width = (float(found["high"]) - float(found["low"])) / ranges if found["high"] is not None else 0.0
    counts = counts.withColumn("_range", F.floor((F.col(column) - F.lit(found["low"])) / F.lit(width)) if width > 0 else F.when(F.col(column).isNotNull(), 0))
    ahead = lambda *order: Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_all"))
    totals = totals.withColumn("_earlier", F.coalesce(F.sum("_all").over(ahead(*keys, "_range")), F.lit(0))).drop("_all")
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (*keys, "_range")]
    inside = counts.withColumn("_before", F.coalesce(F.sum("_n").over(ahead(*keys, "_range", column)), F.lit(0)))
    ranks = inside.alias("x").join(totals.alias("y"), same).select(*(F.col(f"x.{k}").alias(f"_k{i}") for i, k in enumerate(keys)), F.col(f"x.{column}").alias("_value"), (F.col("_earlier") + F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    met = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(column).eqNullSafe(F.col("_value"))]
    return df.join(ranks, met).drop("_value", *(f"_k{i}" for i in range(len(keys))))


def grid_search(candidates: DataFrame, trials: DataFrame, target: str, features: list[str], hit: str, bonus: str, tie: str) -> DataFrame:
    """Hit rate and mean bonus of each trial's best candidate of every target; Catalyst broadcasts the trials if they are small."""
    score = F.lit(0.0)
    for c in features:
        score = score + F.col(c) * F.col(f"w_{c}")
    scored = candidates.join(trials).withColumn("_score", score)
    best = scored.groupBy("trial", target).agg(F.max_by(F.struct(hit, bonus), F.struct("_score", tie)).alias("x"))
    return best.groupBy("trial").agg(F.count("*").alias("targets"), F.avg(F.col(f"x.{hit}").cast("double")).alias("hit_rate"), F.avg(f"x.{bonus}").alias("mean_bonus"))
