"""Catalog sources and result sinks."""
