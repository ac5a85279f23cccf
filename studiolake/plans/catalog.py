"""All registered queries, in build-list order."""

from __future__ import annotations

import importlib

from studiolake.plans.registry import Entry

_MODULES = ["q_core", "q_money", "q_classes", "q_leads", "q_trends", "q_freezes",
            "q_ingest", "q_quality", "q_dashboard", "q_documented"]


def entries() -> list[Entry]:
    out: list[Entry] = []
    for m in _MODULES:
        mod = importlib.import_module(f"studiolake.plans.{m}")
        out.extend(mod.ENTRIES)
    names = [e.name for e in out]
    dup = {n for n in names if names.count(n) > 1}
    assert not dup, f"duplicate query names: {dup}"
    return out


def by_name() -> dict[str, Entry]:
    return {e.name: e for e in entries()}
