"""Evaluation of text detectors on Spark: windows, scores, thresholds, grids."""
