"""Table builders, analyses and models."""
