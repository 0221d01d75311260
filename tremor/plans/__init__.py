"""Composite plans: inversion, simulation, evaluation, operational runs."""
