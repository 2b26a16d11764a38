"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it.  Each module holds one operator with
an interface of its own; ``queries`` derives the registered result columns.
"""
