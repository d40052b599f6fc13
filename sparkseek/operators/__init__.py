"""Search, aggregation, merging and mutation as DataFrame operators."""
