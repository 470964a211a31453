"""Every operator as a registered query over the given tables, each with its
SQL twin where the result can be stated in SQL.  Importing this package fills
the registry."""

from voxloom.catalog import (  # noqa: F401
    build,
    decoding,
    frames,
    preparation,
    rows,
    sampling,
    scoring,
    sequences,
    storage,
)
from voxloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
