"""Composite dataflows and the registered queries."""
