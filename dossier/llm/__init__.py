"""Training-data operators: formatting, deduplication, scoring, mixing and sharding.

Nothing else in the library imports this subpackage; deleting it leaves the
rest working.
"""
