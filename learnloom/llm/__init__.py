"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` binds its operators to the tables.
"""
