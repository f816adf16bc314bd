"""Logical plans of block queries and their execution."""
