"""Named queries over the driver's tables."""

from . import catalogue, codes, grid, lines, packs, streams, writes  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
