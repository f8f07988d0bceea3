"""Import every query module once and hand out the registry."""

from __future__ import annotations

import importlib

from marketlake.plans.registry import ORACLES, QUERIES

MODULES = ["q_bars", "q_flow", "q_structure", "q_macro", "q_quality", "q_zones", "q_data", "q_stream", "q_learn"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"marketlake.plans.{m}")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
