"""Operators for corpora of text: deduplication, filters, scans, tokens and language models."""
