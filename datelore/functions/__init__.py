"""Column expressions: text, numbers, units, dates, identifiers."""
