"""DataFrame operators: filters, aggregates, ranking, similarity, audit, metrics."""
