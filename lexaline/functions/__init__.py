"""Scalar column functions: normalisation, edit distance, relevance."""
