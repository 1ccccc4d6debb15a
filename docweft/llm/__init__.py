"""Operators that prepare text for language-model training.

Nothing outside of this package imports it; ``queries.py`` offers its queries to the entry module.
"""
