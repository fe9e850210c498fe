"""Operators over whole DataFrames: collection, queue, bills, pages,
ranking, summaries."""
