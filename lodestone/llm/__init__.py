"""Operators for preparing training data: filtering, deduplication, mixing, tokens, vectors and pages."""
