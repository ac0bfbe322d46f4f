"""Operators on hypergraphs, treelet tables and samples."""
