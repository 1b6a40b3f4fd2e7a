"""Registered queries by section, each with an independent SQL form for an oracle."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ["metrics", "text", "construction", "learning", "comparison", "serving"]


def queries() -> dict:
    return {k: f for s in SECTIONS for k, f in import_module(f"credence.plans.{s}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for s in SECTIONS for k, f in import_module(f"credence.plans.{s}").ORACLES.items()}
