"""Relational operators: filters, joins, aggregates, windows, allocation and models."""
