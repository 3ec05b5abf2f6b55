"""Operators for building training corpora: one module for each operator.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_<name>`` queries; each derives its contract columns from an operator here.
"""
