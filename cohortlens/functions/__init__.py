"""Scalar helpers: rounding, division, hashing, strings, distributions."""
