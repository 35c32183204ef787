"""Column functions: features, transforms and metrics."""
