"""Operators on DataFrames of points, splats, segments, meshes and graphs."""
