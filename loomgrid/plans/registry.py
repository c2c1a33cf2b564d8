"""All registered queries of the workbench and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from loomgrid.plans import formats, relational, roundtrips, spatial, upkeep, workbench

MODULES = [relational, workbench, spatial, formats, upkeep, roundtrips]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
