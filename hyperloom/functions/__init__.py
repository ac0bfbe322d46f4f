"""Tree algebra, graphlet functions and column expressions."""
