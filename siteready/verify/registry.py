"""All check queries, by importing the modules that register them."""

from __future__ import annotations

import importlib

from siteready.verify import base

MODULES = ("scoring", "friction", "judgments", "events", "checks", "pages", "records", "streaming")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"siteready.verify.{name}")


def queries():
    _load()
    return dict(base.QUERIES)


def oracle_sql():
    _load()
    return base.oracle_sql()
