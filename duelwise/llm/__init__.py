"""Training-data operators: the ten corpus operators and their contract queries.

Nothing outside this subpackage imports it.
"""
