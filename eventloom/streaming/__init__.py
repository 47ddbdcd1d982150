"""Structured Streaming wiring: the batch operators inside ``foreachBatch``."""
