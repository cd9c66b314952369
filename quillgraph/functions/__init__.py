"""Column functions: identities, names, patterns."""
