"""DataFrame operators: graph, joins, suppression, votes, samples, rasters, reports, nested records, running totals."""
