"""All queries of the engine and their SQL."""

from . import arrays, control, io, order, scalars, scans, stats, sync  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
