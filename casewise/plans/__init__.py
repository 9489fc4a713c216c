"""Composite batch jobs built from the operators."""
