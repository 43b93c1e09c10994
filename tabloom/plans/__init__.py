"""Registered queries over the given tables, by family."""

import importlib
import pkgutil

from tabloom.plans.registry import ORACLES, QUERIES

for _module in pkgutil.iter_modules(__path__):
    if _module.name.endswith("_plans"):
        importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
