"""All registered queries."""

from sievework.catalog import graphs, images, models, tables  # noqa: F401
from sievework.catalog.registry import ORACLES, QUERIES  # noqa: F401
