"""Operators for preparing large text corpora for language-model training.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` holds the thin ``opN_*`` queries
over the standard tables and, where SQL can express them, their SQL twins.
"""
