"""Training-data operators: scoring, filtering, matching, mixing and sharding of document tables.

Nothing else in the library imports this subpackage.
"""
