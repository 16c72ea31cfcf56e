"""Column functions: text rules, boxes, scores, vectors, records."""
