"""Registered queries over the test tables and their SQL counterparts."""

from __future__ import annotations

import importlib

from lodestone.registry.base import ORACLE, QUERIES

MODULES = [
    "retrieval",
    "filters",
    "joins",
    "metrics",
    "functions",
    "preparation",
    "decisions",
    "health",
    "coach",
    "evaluation",
    "streams",
]

for _name in MODULES:
    importlib.import_module(f"lodestone.registry.{_name}")

__all__ = ["ORACLE", "QUERIES"]
