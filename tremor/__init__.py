"""Tremor: point-process analytics for event catalogs on Spark DataFrames."""
