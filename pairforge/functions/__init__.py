"""Column functions: text, prompts, vectors."""
