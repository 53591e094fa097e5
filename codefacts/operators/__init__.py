"""Operators: fact resolution during collection and queries over the facts."""
