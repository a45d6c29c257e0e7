"""Operators that prepare training corpora: deduplication, scoring, mixing, archives, tokens."""
