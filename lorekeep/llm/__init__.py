"""Operators of a training-data pipeline: DataFrame in, DataFrame out.

Nothing outside this folder imports it. ``queries`` registers one query per operator.
"""
