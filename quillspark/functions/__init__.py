"""Column expressions: character classes, places in a text, identities, ratios."""
