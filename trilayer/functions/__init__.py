"""Column functions: text, hashing, identity and answer normalisation."""
