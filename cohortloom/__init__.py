"""Cohort features, retrieval and evaluation reports as Spark DataFrame transformations."""
