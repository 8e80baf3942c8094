"""All registered queries and their SQL."""

from . import catalog, raster, runs  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
