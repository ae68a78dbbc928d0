"""Operators for preparing language-model training data, with their registered queries.

Nothing else in the library imports this subpackage. ``queries`` holds the registry.
"""
