"""Spark-native engine for tables that say whether a left entity (a compound)
interacts with a right entity (a protein).

Every operator takes and returns DataFrames.  See README.md for the map from
operators to modules.
"""
