"""The closed catalog of named queries and the envelope around their answers."""
