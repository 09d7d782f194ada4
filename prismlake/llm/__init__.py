"""Operators for preparing a large text collection; nothing outside this package imports it."""

from __future__ import annotations

from ..registry import collect

MODULES = ["p1_names", "p2_neardup", "p3_match", "p4_sample", "p5_terms", "p6_language", "p7_pack", "p8_mix", "p9_subjects"]


def llm_queries():
    return collect([f"prismlake.llm.{m}" for m in MODULES])
