"""DataFrame operators: filters, indexes, lookups, alignment, reductions, sampling, comparison."""
