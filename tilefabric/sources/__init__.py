"""sources of the tile analytics library."""
