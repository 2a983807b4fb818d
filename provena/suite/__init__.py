"""Registered queries over the driver tables, each beside its SQL oracle."""

from __future__ import annotations

import importlib

MODULES = ("recall", "registry", "reports", "codes", "evidence", "texts", "images", "streams")


def registered():
    """(queries, oracles) after loading every suite module."""
    from provena.suite import base

    for name in MODULES:
        importlib.import_module(f"provena.suite.{name}")
    return base.QUERIES, base.ORACLES
