"""Operators for large training corpora: counting, tokenising, deduplicating, filtering, mixing.

Every module holds one operator with a general interface and the thin ``opN_*`` query that applies it to the
corpus tables. Nothing outside this package imports it.
"""
