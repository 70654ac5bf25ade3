"""Scalar, vector and metric functions as Spark column expressions."""
