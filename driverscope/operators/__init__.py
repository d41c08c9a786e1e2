"""Operators over DataFrames: chunks, aggregates, tracks, gaze, folds, metrics."""
