"""Column expressions; each takes and returns a Column."""
