"""Column builders: pure expressions, no actions, no Python in the row path."""
