"""Composed jobs: the registered queries and their plan checks."""
