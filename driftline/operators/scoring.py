"""Scores compiled from declarative rules, value cleaning and effective-dated rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(column: str, default: float = 0.0) -> Column:
    """A number from any text; what does not parse, and NaN, is the default."""
    return F.coalesce(F.nanvl(F.expr(f"try_cast(`{column}` AS DOUBLE)"), F.lit(None).cast("double")), F.lit(default))


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cleans columns to numbers; absent ones become 0."""
    return df.withColumns({c: number(c) if c in df.columns else F.lit(0.0) for c in columns})


def clean_text(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))


@dataclass(frozen=True)
class Term:
    """points * amount for rows where the condition (SQL, optional) holds."""

    points: float
    amount: str = "1"
    when: str | None = None

    def column(self) -> Column:
        value = F.lit(self.points) * F.expr(self.amount)
        return value if self.when is None else F.when(F.expr(self.when), value).otherwise(F.lit(0.0))


def score(terms: list[Term]) -> Column:
    total = F.lit(0.0)
    for term in terms:
        total = total + F.coalesce(term.column(), F.lit(0.0))
    return total


def choose_source(df: DataFrame, choices: dict[str, tuple[str, str]]) -> DataFrame:
    """Per name, the first source if its sum over the whole table is not 0, else the second.

    The sums are one aggregated row, which is read before the plan goes on.
    """
    sums = df.agg(*(F.sum(F.expr(first)).alias(name) for name, (first, _) in choices.items())).first()
    return df.withColumns({name: F.expr(first if sums[name] else second) for name, (first, second) in choices.items()})


# Points of the scoring rules.
BASE = [Term(1.5, "kills"), Term(-1.0, "deaths"), Term(1.0, "assists"), Term(0.01, "cs"), Term(1.0, "firstblood")]
PERFORMANCE = [
    Term(2, when="kp >= 0.70"), Term(2, "triplekills"), Term(3, "quadrakills"), Term(5, "pentakills"), Term(3, when="kills >= 10"),
    Term(3, when="damageshare >= 0.30"), Term(1, when="result = 1"),
    Term(2, when="result = 1 AND ((gamelength > 0 AND gamelength < 1620) OR team_gold - opponent_gold >= 10000)"),
    Term(3, when="deaths = 0 AND kills + assists >= 5"), Term(1, "greatest(0, lead) / 1000"),
    Term(4, "barons_stolen"), Term(4, "elders_stolen"), Term(2, "dragons_stolen"), Term(2, "heralds_stolen"),
]
BY_ROLE = {
    "top": [Term(1, when="solokills > 0"), Term(2, when="damageshare >= 0.25"), Term(2, when="try_divide(damagetaken, team_damagetaken) >= 0.25")],
    "jgl": [Term(1.5, when="team_dragons >= 4"), Term(2, "team_barons"), Term(2, when="kp >= 0.75")],
    "mid": [Term(3, when="damageshare >= 0.30"), Term(1.5, when="cspm15 >= 10")],
    "bot": [Term(1.5, when="cspm15 >= 10"), Term(1, when="dpm >= 1000")],
    "sup": [Term(2, when="assists >= 10"), Term(2, when="kp >= 0.75"), Term(1.5, when="team_firstdragon = 1"), Term(1, "vspm")],
}
STATS = ("kills", "deaths", "assists", "teamkills", "firstblood", "triplekills", "quadrakills", "pentakills", "damageshare", "result", "gamelength", "team_gold", "opponent_gold", "totalcs", "minionkills", "monsterkills", "golddiff14", "golddiff15", "csat15", "cspm", "barons_stolen", "elders_stolen", "dragons_stolen", "heralds_stolen", "solokills", "damagetaken", "team_damagetaken", "team_dragons", "team_barons", "team_firstdragon", "dpm", "vspm")


def fantasy_points(rows: DataFrame, role: str = "position") -> DataFrame:
    """Adds fantasy_pts to participant rows with their team context."""
    df = numbers(rows, list(STATS))
    df = choose_source(df, {"cs": ("totalcs", "minionkills + monsterkills"), "lead": ("golddiff14", "golddiff15"), "cspm15": ("csat15 / 15", "cspm")})
    df = df.withColumn("kp", (F.col("kills") + F.col("assists")) / F.when(F.col("teamkills") == 0, 1.0).otherwise(F.col("teamkills")))
    extra = F.lit(0.0)
    for name, terms in BY_ROLE.items():
        extra = F.when(F.col(role) == name, score(terms)).otherwise(extra)
    return df.withColumn("fantasy_pts", F.bround(score(BASE) + score(PERFORMANCE) + extra, 2))


def effective_rule(df: DataFrame, rules: list[dict], date: Column, group: Column, default: str) -> Column:
    """The last rule (id, groups or none, start, end or none) in force for the row's date and group."""
    chosen = F.lit(default)
    for rule in rules:
        fits = (date >= F.lit(rule["start"]).cast("date")) if rule.get("start") else F.lit(True)
        if rule.get("end"):
            fits = fits & (date <= F.lit(rule["end"]).cast("date"))
        if rule.get("groups"):
            fits = fits & group.isin(*rule["groups"])
        chosen = F.when(fits, F.lit(rule["id"])).otherwise(chosen)
    return chosen


def infer_split(date: str, split: str) -> Column:
    """A missing split is Spring until June, else Summer."""
    return F.coalesce(split, F.when(F.month(date) <= 6, "Spring").otherwise("Summer"))


def phase(split: Column, playoffs: Column) -> Column:
    return F.when(playoffs, F.concat(split, F.lit(" Playoffs"))).otherwise(split)


# Splits of rows that name none, by the start of their date; all others are Spring.
UNNAMED_SPLITS = {"2026-04": "Spring", "2026-05": "Spring", "2026-06": "Spring", "2025-10": "Lock-In", "2026-01": "Lock-In", "2026-02": "Lock-In", "2026-03": "Lock-In"}
QUALIFIERS = "NA EWC Qualifiers"


def build_phase(split: str, date: str, playoffs: str) -> Column:
    """The phase of a row: its split (named by month where it has none), with the play-offs apart."""
    own = F.trim(F.coalesce(F.col(split).cast("string"), F.lit("")))
    months = F.create_map(*(F.lit(x) for pair in UNNAMED_SPLITS.items() for x in pair))
    unnamed = F.coalesce(months[F.substring(F.coalesce(F.col(date).cast("string"), F.lit("")), 1, 7)], F.lit("Spring"))
    name = F.when(own.contains("EWC"), QUALIFIERS).when(own.isin("", "nan", "None", "Regular"), unnamed).otherwise(own)
    late = F.trim(F.coalesce(F.col(playoffs).cast("string"), F.lit("0"))) == "1"
    return F.when(late & ~name.endswith("Playoffs"), F.concat(name, F.lit(" Playoffs"))).otherwise(name)


def alias(column: str, names: dict[str, str]) -> Column:
    """A name's canonical form, compared without case."""
    pairs = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k.lower(), v)))
    return F.coalesce(pairs[F.lower(F.trim(column))], F.col(column))


def adjusted(points: str, factor: str) -> Column:
    return F.bround(F.col(points) * F.coalesce(factor, F.lit(1.0)), 2)
