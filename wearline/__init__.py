"""Run-to-failure analytics as DataFrame-to-DataFrame functions on Spark."""
