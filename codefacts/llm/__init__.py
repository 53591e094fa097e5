"""Operators for preparing training data: search, deduplication, scoring, mixing and packing.

Nothing else in the library imports this package. ``codefacts.llm.queries``
registers one query per operator; ``corpus_pipeline`` at the repository top
chains five of them.
"""
