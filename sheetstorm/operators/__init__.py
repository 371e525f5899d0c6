"""Operators over samples and tables: simulation, summaries, histograms, lookups, scenarios."""
