"""Noisy-channel text analytics on Spark."""
