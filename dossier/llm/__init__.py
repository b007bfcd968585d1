"""Operators for training-data pipelines: search, near-dedup, packing, scanning, scoring, mixing, archiving."""
