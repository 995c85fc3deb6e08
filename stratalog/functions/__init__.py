"""Column expressions: text, scores, versions, URLs."""
