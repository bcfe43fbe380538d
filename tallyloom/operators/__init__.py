"""The verbs on feature matrices: index, filter, mask, query, score, merge, and the companion tools."""
