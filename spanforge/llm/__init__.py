"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries.py`` derives the digest columns
that the registered ``opN_*`` queries return.
"""
