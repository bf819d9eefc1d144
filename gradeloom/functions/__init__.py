"""Column expressions: each takes and returns columns, so Catalyst sees all of them."""
