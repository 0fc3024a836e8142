"""Operators for preparing language-model training data.

The rest of the library never imports this subpackage, so it can be removed
without touching anything else.
"""
