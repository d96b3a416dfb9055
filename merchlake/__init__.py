"""Commerce analytics on Spark: reports, change flows, quality rules and streams."""
