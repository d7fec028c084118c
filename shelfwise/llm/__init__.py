"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Each operator is a module with a
general interface; ``queries`` applies them to the ``documents`` table.
"""
