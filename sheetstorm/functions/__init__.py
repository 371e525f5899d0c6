"""Column expressions: IEEE arithmetic, keyed random draws, the normal distribution, calendar and rounding."""
