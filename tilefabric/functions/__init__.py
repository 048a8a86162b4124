"""functions of the tile analytics library."""
