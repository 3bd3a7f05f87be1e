"""Column functions: text and number semantics, transforms, arithmetic expressions."""
