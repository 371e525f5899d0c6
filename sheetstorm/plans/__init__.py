"""Formulas, periods, compiled programs and their lowering to columns."""
