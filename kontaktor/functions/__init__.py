"""Column expressions: no Python runs for them."""
