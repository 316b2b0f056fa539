"""Spark-native analytics workbench: lazy jobs from tables to DataFrames."""
