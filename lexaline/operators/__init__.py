"""Ranking, indexes and search over a corpus of (ord, word, normalized, weight)."""
