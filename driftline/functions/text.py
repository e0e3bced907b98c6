"""Small column functions over names, rounds, splits and vectors of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def player_key(name: str) -> Column:
    """A name compared without case and outer blanks."""
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def slug(text: str) -> Column:
    """Lower case with every run of other characters than letters and digits as one dash; unknown-round for nothing."""
    found = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(found == "", "unknown-round").otherwise(found)


def pricing_period(split: str) -> Column:
    return F.regexp_replace(split, r" Playoffs$", "")


def market_split(round_name: str, names: dict[str, str]) -> Column:
    """The split that a round's "Split n" stands for; an unknown one is an error."""
    number = F.regexp_extract(round_name, r"(?i)Split\s+(\d+)", 1)
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(pairs[number], F.raise_error(F.concat(F.lit("no split in round: "), F.coalesce(round_name, F.lit("")))).cast("string"))


def opening_round(round_name: str) -> Column:
    return F.coalesce(F.col(round_name).rlike(r"(?i)\bRound\s*1\b"), F.lit(False))


def pair_key(a: str, b: str) -> Column:
    """An unordered pair as an array in order."""
    return F.array(F.least(a, b), F.greatest(a, b))


def unpivot(df, keys: list[str], columns: list[str], name: str, value: str):
    """One row for each non-empty value of some columns."""
    return df.unpivot(keys, columns, name, value).where(F.trim(F.coalesce(value, F.lit(""))) != "")


# What the market's splits of 2026 are called on boards.
DASHBOARD_SPLITS = {"Split 1": "Lock-In", "Split 2": "Spring", "Split 3": "Summer"}


def dashboard_split(year: str, round_name: str) -> Column:
    """The board's name of a market round's split; other rounds keep their own, and an empty one is the official market."""
    out = F.trim(F.coalesce(round_name, F.lit("")))
    out = F.when(out == "", "Official Market").otherwise(out)
    for name, board in reversed(DASHBOARD_SPLITS.items()):
        out = F.when((F.col(year).cast("string") == "2026") & F.col(round_name).contains(name), board).otherwise(out)
    return out


def natural_order(name: str) -> list[Column]:
    """Sort keys that put Week 2 before Week 10: the first number, then the text; names without one come last."""
    return [F.expr(f"try_cast(nullif(regexp_extract(`{name}`, '([0-9]+)', 1), '') AS INT)").asc_nulls_last(), F.col(name).asc()]


def side_value(side: Column, blue: str | Column, red: str | Column) -> Column:
    """The value of the row's own side."""
    return F.when(side == "Blue", blue).when(side == "Red", red)


def pick_set(*picks: str) -> Column:
    """Distinct trimmed names of some columns, without empty ones."""
    return F.array_distinct(F.filter(F.array(*(F.trim(F.coalesce(p, F.lit(""))) for p in picks)), lambda x: x != ""))


def in_period(league: Column, year: Column, leagues: list[str], first: int, last: int) -> Column:
    """Whether a row belongs to a league and a span of years, both ends included."""
    return F.coalesce(league.isin(*leagues) & year.between(first, last), F.lit(False))
