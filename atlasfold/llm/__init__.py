"""Operators for cleaning, scoring and encoding training text at scale.

Each module has one operator; ``queries`` binds them to the driver's tables.
Nothing outside this subpackage imports it.
"""
