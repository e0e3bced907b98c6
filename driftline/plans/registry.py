"""Queries of the engine and their SQL oracles, collected from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ("asof", "ablations", "rules", "contexts", "sequences", "drafts", "storage", "streams", "strategies", "records", "profiles", "versions", "rankings", "folds", "labs", "lineups", "markets", "models", "views")


def _modules():
    return [importlib.import_module(f"driftline.plans.{name}") for name in MODULES]


def queries() -> dict:
    return {name: run for module in _modules() for name, run in module.plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.plans.sql.items()}
