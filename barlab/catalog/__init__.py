"""Runnable queries over the test tables, with their reference SQL."""

from barlab.catalog import (  # noqa: F401
    bars_queries, eval_queries, integrity_queries, model_queries, risk_queries, signal_queries, store_queries,
)
from barlab.catalog.registry import ORACLES, QUERIES  # noqa: F401
