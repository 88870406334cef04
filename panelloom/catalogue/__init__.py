"""Every operator as a named query over the given tables."""

from panelloom.catalogue import (  # noqa: F401
    aggregation,
    domain,
    estimation,
    joining,
    reshaping,
    scalars,
    scans,
    selecting,
    windowing,
)
from panelloom.catalogue.registry import COVERS, QUERIES, STATEMENTS, with_tables

ORACLES = {name: with_tables(sql) for name, sql in STATEMENTS.items()}

__all__ = ["COVERS", "ORACLES", "QUERIES"]
