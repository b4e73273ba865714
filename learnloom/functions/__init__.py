"""Column expressions: text, emotions, similarity."""
