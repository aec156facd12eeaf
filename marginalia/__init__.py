"""Marginalia: multi-reviewer manuscript analytics expressed as Spark DataFrames."""
