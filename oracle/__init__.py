"""SQL counterparts of the queries, for another engine over the same files."""
