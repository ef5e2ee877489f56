"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

import importlib

MODULES = ["statistics", "color", "views", "catalogue", "resampling", "rendering", "requests", "files", "stores"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessella.suite.{name}")
