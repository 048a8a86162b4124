"""plans of the tile analytics library: importing it registers all queries."""

from . import composites, frames, more, queries  # noqa: F401
