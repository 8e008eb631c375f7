"""All registered queries."""

from mediaspark.plans import (  # noqa: F401
    audio_queries,
    extra_queries,
    join_queries,
    line_queries,
    live_queries,
    packet_queries,
    source_queries,
    stat_queries,
)
from mediaspark.plans.fixtures import sql as with_views
from mediaspark.plans.registry import ORACLES, QUERIES

ORACLES |= {"best_format": extra_queries.BEST_FORMAT, "lpc_order": with_views(extra_queries.LPC_ORDER)}

__all__ = ["ORACLES", "QUERIES"]
