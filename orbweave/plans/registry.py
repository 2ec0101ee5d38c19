"""Queries of the scenario and schedule operators and their SQL."""

from __future__ import annotations

from orbweave.operators import candidates, catalogs, conflicts, datasets, downlinks, grouped, lookahead, objective, replay, resources, rules, schedules, stations, sweeps, texts, trajectories, validation
from orbweave.streaming import events

MODULES = (candidates, conflicts, sweeps, schedules, downlinks, stations, trajectories, catalogs, texts, datasets, grouped, replay, objective, lookahead, resources, rules, validation, events)


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
