"""Operators for corpora and very large identifier or number columns. Nothing outside imports this."""
