"""Column types and the expressions that coerce values to them."""
