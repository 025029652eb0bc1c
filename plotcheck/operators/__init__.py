"""DataFrame operators: spatial joins, raster and point aggregation, evaluation, rules."""
