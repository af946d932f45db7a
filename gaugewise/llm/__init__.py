"""Operators for preparing large text corpora: one module for each operator.

Nothing outside this subpackage imports it.
"""
