"""Source text to symbols, references, imports and attributes."""
