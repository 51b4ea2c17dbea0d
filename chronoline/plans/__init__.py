"""Registered queries and the plans behind them."""

from __future__ import annotations

import importlib

_MODULES = ("event_queries", "metric_queries", "signal_queries", "record_queries")


def load_catalog():
    for m in _MODULES:
        importlib.import_module(f"chronoline.plans.{m}")
    return importlib.import_module("chronoline.plans.catalog")
