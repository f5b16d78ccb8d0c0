"""Stage boundaries and the composed customer mart."""
