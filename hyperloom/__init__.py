"""Motif analytics over hypergraphs and graphs, as Spark DataFrame plans."""
