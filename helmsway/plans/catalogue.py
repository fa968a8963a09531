"""All registered queries of the core and their SQL."""

from __future__ import annotations

from helmsway.plans import checks, clouds, evidence, problems, streams

MODULES = [problems, streams, evidence, clouds, checks]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
