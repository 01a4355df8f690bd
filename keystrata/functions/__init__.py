"""Column functions: hashing, embeddings, formatting and predicates."""
