"""All registered queries."""

from gridcast.plans import strength_queries  # noqa: F401
from gridcast.plans import evaluation_queries  # noqa: F401
from gridcast.plans import player_queries  # noqa: F401
from gridcast.plans import market_queries  # noqa: F401
from gridcast.plans import ingest_queries  # noqa: F401
