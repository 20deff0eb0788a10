"""Operators for preparing training text: counts, filters, de-duplication, mixing and token output."""
