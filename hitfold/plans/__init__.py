"""The read API: lazy DataFrames over the rollups."""
