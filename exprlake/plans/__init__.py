"""Whole tasks composed from the operators: SQL over releases, combining, validation."""
