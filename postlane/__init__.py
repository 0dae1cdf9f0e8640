"""Conjunctive search over inverted indexes and posting-list compression on Spark DataFrames."""
