"""All named queries."""

from meterlens.catalog import cleaning, exploration, files, jobs, reports, scoring, segments, streams  # noqa: F401
from meterlens.catalog.registry import ORACLES, QUERIES  # noqa: F401
