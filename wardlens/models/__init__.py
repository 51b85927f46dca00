"""Training and scoring on DataFrames with the Spark ML estimators."""
