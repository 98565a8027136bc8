"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from pointloom.plans import core, drawn, modelled, more, rasters, reference  # noqa: F401  (they register their queries in reference)

QUERIES = {**core.QUERIES, **reference.QUERIES}
SQL = {**core.SQL, **reference.SQL}
