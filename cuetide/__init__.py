"""Timed-text analytics on Spark: noisy, time-ordered evidence to clean, explainable cues."""
