"""Relational operators: pure DataFrame -> DataFrame functions."""
