"""Whole jobs composed of operators: index building, alignment, comparison."""
