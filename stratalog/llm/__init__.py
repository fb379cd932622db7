"""Operators of a large-scale training-data pipeline.

The subpackage stands alone: nothing else in the library imports it, and it
imports nothing from the rest of the library.
"""
