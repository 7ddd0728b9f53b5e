"""Operators that prepare documents for language-model training.

Nothing else in the package imports this subpackage.
"""
