"""Operators for large training-text pipelines, each a DataFrame-in, DataFrame-out function.

Nothing outside this subpackage imports it.
"""
