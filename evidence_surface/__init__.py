"""Surfaces and area summaries from labelled evidence points, on Spark."""
