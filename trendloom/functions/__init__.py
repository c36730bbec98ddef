"""Column expressions: scalar functions, rule tables, reason lists."""
