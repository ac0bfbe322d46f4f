"""Hypergraphs from event streams."""
