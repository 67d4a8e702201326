"""The registered queries over the packet views, and their SQL."""

from __future__ import annotations

from . import flow_queries, frame_queries, protocol_queries, text_queries

QUERIES: dict = {**flow_queries.QUERIES, **text_queries.QUERIES, **frame_queries.QUERIES, **protocol_queries.QUERIES}
ORACLES: dict = {**flow_queries.ORACLES, **text_queries.ORACLES, **frame_queries.ORACLES, **protocol_queries.ORACLES}
