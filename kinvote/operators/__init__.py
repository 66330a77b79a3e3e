"""Relational, vector and graph operators of the core engine."""
