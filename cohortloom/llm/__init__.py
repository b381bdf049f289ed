"""Operators for training-data pipelines. Nothing else in cohortloom imports this subpackage."""
