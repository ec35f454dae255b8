"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; the driver entry point
registers its queries only when it can be imported.
"""
