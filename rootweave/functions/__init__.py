"""Column functions: identifiers, texts, numbers."""
