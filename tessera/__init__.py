"""A PySpark-native document retrieval and data-processing engine.

Every operator takes DataFrames and returns a lazy DataFrame; the physical
strategy is left to Catalyst.  See README.md for the layout.
"""
