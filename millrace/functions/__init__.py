"""Scalar helpers that operators share: key hashing and Bloom sizing arithmetic."""
