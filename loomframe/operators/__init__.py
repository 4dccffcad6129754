"""DataFrame operators, by kind of work."""
