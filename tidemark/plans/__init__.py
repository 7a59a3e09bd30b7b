"""One module per operator family; importing them fills the registry."""

import importlib
import pkgutil

from tidemark.plans.registry import COVERS, ORACLES, QUERIES

for _m in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["COVERS", "ORACLES", "QUERIES"]
