"""Numerical analytics on tables: n-dimensional array operations, estimators and tensor operators as DataFrame queries."""
