"""Ordered, windowed, relational and statistical operators."""
