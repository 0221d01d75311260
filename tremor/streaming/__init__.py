"""Catalogs as streams."""
