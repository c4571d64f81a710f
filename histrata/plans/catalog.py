"""All queries of the core, and the SQL each is compared with."""

from __future__ import annotations

from importlib import import_module

#: Modules that define QUERIES (name -> callable(spark, folder)) and ORACLE (name -> SQL).
MODULES = ("hierarchy", "graph", "scans", "treediff", "text", "packs", "sets", "formats")


def collect() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in MODULES:
        module = import_module(f"{__package__}.{name}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
