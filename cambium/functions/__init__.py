"""Column-level functions: projections, gates' scalars, costs, polygons, strings."""
