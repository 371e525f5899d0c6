"""Workbooks as versioned JSON, series from tables, and cells as tables."""
