"""Registered queries: name -> (Spark callable, check SQL or None)."""

from __future__ import annotations

from jobspectra.plans.catalog import market, normalization, tables, texts

ENTRIES: dict[str, tuple] = {}
for _module in (market, normalization, tables, texts):
    ENTRIES.update(_module.ENTRIES)
