"""The query catalogue of the core."""

from __future__ import annotations

from ..registry import collect

MODULES: list[str] = ["lenses", "partitions", "texts", "vectors", "searching", "evidence", "views", "files", "modelling"]


def core_queries():
    return collect([f"prismlake.plans.{m}" for m in MODULES])
