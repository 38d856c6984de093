"""Relational operators and the analytics built from them."""
