"""Operators for building language-model training sets.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
"""
