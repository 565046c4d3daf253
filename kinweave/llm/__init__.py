"""Operators for training-data corpora: deduplication, decontamination, filters, extraction, packing."""
