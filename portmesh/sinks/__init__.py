"""Writers for tables, XML, METIS, DOT, JSON and pixel tables."""
