"""sources of the terrain engine."""
