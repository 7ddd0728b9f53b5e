"""Scalar functions: text primitives, validators, span search."""
