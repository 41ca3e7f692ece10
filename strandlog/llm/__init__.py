"""Operators for preparing training data: formatting, counting, sharding, filtering, packing and writing.

Every operator is usable on its own DataFrame; `queries` applies each of them to the driver tables.
"""
