"""Column expressions: tokens, hashes, vectors."""
