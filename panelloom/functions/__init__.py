"""Column expressions: names, calendar, numbers."""
