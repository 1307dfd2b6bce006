"""Operators of a training-data pipeline over documents and pages.

Each operator is one module with its own interface; ``queries`` registers one query for
each of them, and ``corpus_pipeline`` at the top of the repository chains five.
"""
