"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage. Operators take DataFrames
and column names; ``queries`` registers one thin query per operator.
"""
