"""Scalar, vector and text functions."""
