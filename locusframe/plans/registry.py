"""Name -> query and name -> SQL text, gathered from the operator modules.

A module of ``locusframe.operators`` takes part by listing itself in MODULES;
it offers ``QUERIES`` (name -> function of (spark, sf_dir)) and ``ORACLES``
(name -> SQL over the driver tables).
"""

from __future__ import annotations

import importlib

MODULES: list[str] = ["summary", "relationship", "filters", "joins", "scalars", "stats", "models", "mixed", "ordination", "annotations", "interchange", "streams", "gvcf", "variants", "mixed_blocks", "orders", "exact", "trees", "kmers"]


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"locusframe.operators.{name}"), what)
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"{what} registered twice: {sorted(clash)}")
        found.update(part)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict:
    return _gather("ORACLES")
