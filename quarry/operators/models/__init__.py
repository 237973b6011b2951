"""Estimators: fit by aggregates over rows, score by projections."""
