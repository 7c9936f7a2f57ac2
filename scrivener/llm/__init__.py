"""Operators of a training-data pipeline: ten table-valued operators, each in a module of its own, and their queries.

Nothing outside this subpackage imports it.
"""
