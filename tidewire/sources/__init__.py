"""Readers and writers for captures, envelopes, flow tables and metrics."""
