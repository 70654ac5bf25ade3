"""Pipelines composed of operators: preparation, training, tuning, reporting."""
