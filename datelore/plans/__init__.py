"""Driver-facing queries built from the operators, and shared plan helpers."""
