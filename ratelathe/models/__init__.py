"""Rating-prediction models: configuration, fitting and scoring."""
