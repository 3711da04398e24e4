"""Operators for large training corpora; nothing else in the package imports this."""
