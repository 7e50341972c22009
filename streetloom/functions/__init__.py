"""Column-level functions: geometry, projections, tags, travel times."""
