"""Column builders: sequences, count vectors, distances, scores."""
