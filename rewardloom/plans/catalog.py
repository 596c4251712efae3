"""All queries. Importing this module registers them."""

from rewardloom.plans import (  # noqa: F401
    reward_queries, sources_queries, stream_queries, table_queries, text_queries,
)
from rewardloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
