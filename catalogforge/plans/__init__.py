"""Whole jobs: exports to compiled table, compiled table to catalogue."""
