"""Tail-forecast recalibration and audit on Spark."""
