"""Column expressions: hashing, formulas, metrics, normal distribution."""
