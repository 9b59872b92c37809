"""Every registered query and its DuckDB oracle."""

from __future__ import annotations

from lectern.plans import clip_queries, job_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **clip_queries.QUERIES, **job_queries.QUERIES}
ORACLES: dict = {**text_queries.ORACLES, **clip_queries.ORACLES, **job_queries.ORACLES}
