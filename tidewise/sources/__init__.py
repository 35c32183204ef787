"""Sources, sinks and connectors."""
