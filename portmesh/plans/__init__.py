"""Whole-model build and the read views on top of it."""
