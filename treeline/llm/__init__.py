"""Operators of a training-data pipeline over tables of texts.

Nothing else in the package imports this folder. Every operator takes DataFrames,
names its columns by parameter, and treats a null text as an empty one.
"""
