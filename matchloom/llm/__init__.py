"""Operators for preparing training data: quality, toxicity, de-duplication, packing, encoding and layout."""
