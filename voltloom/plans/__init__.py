"""Named queries over the driver tables, with the SQL each is checked against."""

from . import clockwork, forecasting, ingest, statistics, targets, windowed
from .catalog import ORACLES, QUERIES

__all__ = ["all_oracles", "all_queries", "clockwork", "forecasting", "ingest", "statistics", "targets", "windowed"]


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
