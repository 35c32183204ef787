"""Dataflow operators on panels."""
