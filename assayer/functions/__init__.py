"""Column expressions: text preparation, numbers, tokens, statistics."""
