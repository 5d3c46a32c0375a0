"""The registered queries, one module per subject."""

from __future__ import annotations

import importlib
import pkgutil

from tracelode.plans.registry import CHECKS, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _module != "registry":
        importlib.import_module(f"{__name__}.{_module}")

__all__ = ["CHECKS", "QUERIES"]
