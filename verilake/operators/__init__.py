"""DataFrame operators: joins, aggregations, windows and orderings."""
