"""Registered queries: name -> Spark program, with the SQL that states the same result."""

from __future__ import annotations

import importlib

from isohyet.queries.registry import ORACLES, QUERIES

MODULES = ["features", "tables", "samples", "backtest", "drift", "blending", "ranking", "models"]
for _name in MODULES:
    importlib.import_module(f"isohyet.queries.{_name}")

__all__ = ["ORACLES", "QUERIES"]
