"""Column expressions: seeded draws, distributions over options, text."""
