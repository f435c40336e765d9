"""Column expressions: paths, text, scores, statistics and labels."""
