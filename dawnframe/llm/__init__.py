"""Operators for language-model training data: filters, detectors, deduplication, mixing, formatting, extraction."""
