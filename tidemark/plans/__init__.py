"""The registered queries, by family."""

import importlib
import os
import pkgutil

from tidemark.plans.registry import all_oracles, all_queries

for _module in pkgutil.iter_modules([os.path.dirname(__file__)]):
    if _module.name != "registry":
        importlib.import_module(f"tidemark.plans.{_module.name}")

__all__ = ["all_oracles", "all_queries"]
