"""Media-library analytics on Spark: metadata index, hybrid search, rollups, change feed, metrics."""
