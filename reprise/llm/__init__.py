"""Operators for preparing training data: packing, extraction, de-duplication, mixing and search."""
