"""Catalogue search, substitute matching and cross-reference upkeep on Spark.

Every operator takes DataFrames and returns DataFrames; planning, shuffles and
execution are left to Catalyst and AQE. See README.md for the operator map.
"""

__version__ = "0.1.0"
