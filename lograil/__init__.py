"""Keyed-log analytics on Spark: ordered mutation logs, derived keyspaces, and their statistics."""
