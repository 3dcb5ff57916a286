"""functions of the terrain engine."""
