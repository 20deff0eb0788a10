"""Readers and generators; each returns DataFrames."""
