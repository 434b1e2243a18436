"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ["folioflow.plans." + m for m in ("text", "headings", "tables", "regions", "ranking", "geometry", "models", "streams", "sara_am", "gates", "studio", "exchange", "pixels")]


def load() -> None:
    for name in MODULES:
        importlib.import_module(name)
