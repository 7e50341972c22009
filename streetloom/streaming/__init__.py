"""Structured Streaming sources of edge weights."""
