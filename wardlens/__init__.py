"""Cohort selection, note cleaning, feature building and model evaluation as Spark DataFrame operators."""

__version__ = "0.1.0"
