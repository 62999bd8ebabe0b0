"""DataFrame operators of the resolution engine."""
