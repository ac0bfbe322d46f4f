"""Text formats and data sources."""
