"""Joins, aggregates and ordered operators over DataFrames."""
