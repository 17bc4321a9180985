"""Spanning-tree fusion clustering jobs on Spark DataFrames."""
