"""Registered queries and their DuckDB oracles."""

from gridfold.catalog.registry import ORACLES, QUERIES  # noqa: F401
from gridfold.catalog import (q_reduce, q_select, q_landcover, q_points,  # noqa: F401,E402
                              q_reproject, q_align, q_io, q_jobs, q_big, q_ingest, q_store)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
