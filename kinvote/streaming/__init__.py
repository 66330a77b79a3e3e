"""Label transfer over a stream of queries."""
