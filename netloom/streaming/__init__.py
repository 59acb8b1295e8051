"""Incremental metrics over a stream of nonzeros."""
