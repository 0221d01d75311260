"""Operators on catalogs: filters, joins, statistics, windows, tests."""
