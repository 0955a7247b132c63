"""Collects the query plans of this package."""

from __future__ import annotations

from collections.abc import Callable

from . import evaluation, graphs, mapped, payloads, relational, search, textual

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
for _m in (relational, textual, search, graphs, mapped, payloads, evaluation):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
