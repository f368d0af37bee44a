"""All registered queries and their check statements."""

from __future__ import annotations

from importlib import import_module

_FAMILIES = ("features", "extraction", "ledger", "forecast", "evaluation", "monitoring")


def _collect(prefix: str, attribute: str) -> dict:
    found: dict = {}
    for family in _FAMILIES:
        try:
            module = import_module(f"pitsignal.plans.{prefix}_{family}")
        except ModuleNotFoundError as missing:
            if missing.name != f"pitsignal.plans.{prefix}_{family}":
                raise
            continue
        found.update(getattr(module, attribute))
    return found


def all_queries() -> dict:
    return _collect("queries", "QUERIES")


def all_oracles() -> dict:
    return _collect("oracle", "ORACLE")
