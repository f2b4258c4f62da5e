"""Registered queries, their inputs and their SQL checks."""

from tidewire.plans import flow_queries, io_queries, ml_queries, packet_queries, stream_queries  # noqa: F401
from tidewire.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
