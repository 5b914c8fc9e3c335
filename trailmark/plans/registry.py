"""Every registered query of the library, by name."""

from __future__ import annotations

from trailmark.plans import chain_queries, device_queries, geo_queries, place_queries, reading_queries, request_queries, track_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (geo_queries, chain_queries, track_queries, reading_queries, device_queries, place_queries, request_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
