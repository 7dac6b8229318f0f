"""Fitted detectors as parameter tables, fitted and applied by Spark jobs."""
