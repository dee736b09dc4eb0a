"""Listing, building, searching and workload generation over DataFrames."""
