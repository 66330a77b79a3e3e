"""Query catalogues: named queries over a data directory and their SQL."""
