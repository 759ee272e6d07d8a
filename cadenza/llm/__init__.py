"""Operators for training data: nearest-time matching of streams, packing, mixing and language labels."""
