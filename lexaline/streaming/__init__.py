"""Streams of queries (an extension: the batch operators over micro-batches)."""
