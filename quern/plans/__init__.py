"""Helpers that shape physical plans: lineage cuts and skew-safe joins."""
