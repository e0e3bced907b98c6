"""What the review of round 4 found, on tables small enough to read."""

import duckdb

from driftline.plans import registry
from tests.test_findings_r03 import SF


def test_items_of_opponents_are_not_broadcast(spark):
    """A team's items grow with the input, however small their files look to the planner."""
    from driftline.operators import profiles

    actions = spark.createDataFrame([(1, "a", 10, "15.1", "ban", "x"), (1, "a", 10, "15.1", "pick", "y"), (2, "b", 11, "15.1", "ban", "x")], "game int, team string, time long, patch string, action_type string, champion string")
    targets = spark.createDataFrame([(3, "a", 12, "15.1"), (4, "a", 12, "15.9")], "target int, opponent string, cutoff long, patch string")
    found = profiles.draft_rates_before(actions, targets, days=1)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(t, c, b, p, u, 1) for t in (3, 4) for c, b, p, u in (("x", 1.0, 0.0, 1.0), ("y", 0.0, 1.0, 0.0))]
    assert sorted(map(tuple, found.collect())) == want
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_opponent_rates_are_rounded_as_in_sql(spark, monkeypatch):
    """Scaled by a million, 811 / 3200 lies under a tie, and its shortest text lies on it."""
    from driftline.operators import profiles

    want = duckdb.execute("select round_even(811 / 3200, 6)").fetchone()[0]
    monkeypatch.setattr(profiles, "draft_rates_before", lambda *rest, **named: spark.sql("select 1 as target, 'c' as champion, 0.0D as ban_rate, 0.0D as pick_rate, 811 / 3200D as public_ban_rate, 1 as games"))
    assert registry.queries()["opponent_rates"](spark, "/root/testdata/sf0.001").first()["public_ban_rate"] == want
