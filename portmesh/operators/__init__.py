"""Joins, roll-ups, timelines, checks, partitioning and iterative numerics on DataFrames."""
