"""Stance-tagged claim analytics on Spark DataFrames."""
