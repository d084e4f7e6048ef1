"""Operators over DataFrames: lookups, closures, groupings, trees, reports, layout."""
