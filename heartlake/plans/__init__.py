"""Workflows built of operators: labels, subsets, matrices, shifts and their analysis."""
