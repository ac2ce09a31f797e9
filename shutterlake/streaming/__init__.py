"""The change feed as a stream."""
