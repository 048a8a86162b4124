"""streaming of the tile analytics library."""
