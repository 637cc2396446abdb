"""Scalar functions, sketches and reusable expressions."""
