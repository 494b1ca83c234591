"""Operators for training-data pipelines: deduplication, decontamination, scoring, extraction, tokens and packing."""
