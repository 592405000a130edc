"""Queries over DataFrames of pages, search results and company rows."""
