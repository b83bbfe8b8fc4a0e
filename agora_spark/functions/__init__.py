"""Column helpers: every function takes and returns Columns, so Catalyst sees plain expressions."""
