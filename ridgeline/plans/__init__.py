"""plans of the terrain engine."""
