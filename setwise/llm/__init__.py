"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
