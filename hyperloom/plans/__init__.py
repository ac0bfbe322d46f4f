"""Whole plans: the build pipeline and the catalogue of queries."""
