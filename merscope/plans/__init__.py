"""Whole queries: the histogram, its report, and the query catalog."""
