"""Training-data operators: deduplication, filtering, mixing, tokenising, sharding, search.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; ``queries`` holds the registered
queries that apply the operators to whole tables.
"""
