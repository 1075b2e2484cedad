"""Column expressions: text signals, scalars, HTML."""
