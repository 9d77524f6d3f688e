"""Declarative event selection over nested collections, compiled to Spark DataFrames."""
