"""Connected components, as the rest of the library has them."""

from geojobs.operators.components import connected_components, with_least

__all__ = ["connected_components", "with_least"]
