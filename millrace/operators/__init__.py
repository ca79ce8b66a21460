"""Dataflow operators: joins, co-groups, aggregation, Bloom filters, row functions, counters."""
