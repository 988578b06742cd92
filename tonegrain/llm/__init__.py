"""Operators for preparing text corpora: scoring, scanning, deduplication, mixing, packing."""
