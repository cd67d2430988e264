"""All registered queries."""

from tripwave.plans import sample_queries  # noqa: F401
from tripwave.plans import window_queries  # noqa: F401
from tripwave.plans import label_queries  # noqa: F401
from tripwave.plans import report_queries  # noqa: F401
from tripwave.plans import source_queries  # noqa: F401
from tripwave.plans import model_queries  # noqa: F401
from tripwave.plans import stream_queries  # noqa: F401
from tripwave.plans import fact_queries  # noqa: F401
from tripwave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
