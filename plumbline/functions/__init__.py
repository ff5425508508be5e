"""Scalar Column functions and the distribution UDFs."""
