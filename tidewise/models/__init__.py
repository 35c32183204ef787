"""Forecast models: a registry of specs, column expressions, numpy kernels and panel models."""
