"""Collects the queries of all workload modules."""

from workload.base import ORACLES, QUERIES  # noqa: F401
from workload import spatial, catalog, temporal, sequences, signals, decisions, streams, landing  # noqa: F401
