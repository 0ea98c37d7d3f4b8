"""Column helpers: text, scores, vectors, ids."""
