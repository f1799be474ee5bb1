"""Operators for building training data: formatting, scanning, deduplication, scoring and mixing."""
