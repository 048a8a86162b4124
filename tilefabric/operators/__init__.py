"""operators of the tile analytics library."""
