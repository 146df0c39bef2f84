"""Name -> query builder, and name -> SQL, of the engine's own operators."""

from reelspark.plans import aggregates, authoring, blocks, containers, filters, joined, nested, ordered, scalars, streams, texts, toolkit  # noqa: F401  they register their queries
from reelspark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
