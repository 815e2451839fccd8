"""Preprocessing, linear models, clustering, small networks, metrics and splits over DataFrames: a column for each feature."""
