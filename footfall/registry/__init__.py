"""Named queries over the star schema, and the same questions in SQL for checking them."""

from footfall.registry import streams as _streams  # noqa: F401  (registers the streaming queries)
from footfall.registry import tasks as _tasks  # noqa: F401  (registers whole tasks)
from footfall.registry.queries import QUERIES

__all__ = ["QUERIES"]
