"""Operators of a training-data pipeline: sharding, token files, encoding, packing, quality and near-duplicate removal.

Nothing else in the library imports this subpackage.
"""
