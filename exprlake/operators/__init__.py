"""Operators on the long expression matrix, on samples, and on whole releases."""
