"""Training-data operators: near-duplicate joins, tokenizing, scoring, extraction, packing.

Nothing else in the library imports this subpackage.  ``queries.py`` registers one query per operator.
"""
