"""operators of the terrain engine."""
