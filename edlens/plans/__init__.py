"""Ready-made plans: operators applied to the test tables."""

from __future__ import annotations

import importlib

PLAN_MODULES: list[str] = [
    "relational", "columns", "ordered", "splitting", "profiling", "evaluation", "testing", "domains", "preparing", "modelling", "sourcing",
]


def load_all():
    from edlens.plans.registry import QUERIES

    for name in PLAN_MODULES:
        importlib.import_module(f"edlens.plans.{name}")
    return QUERIES
