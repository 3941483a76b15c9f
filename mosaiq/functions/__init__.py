"""Column functions: path metadata, grids, score texts."""
