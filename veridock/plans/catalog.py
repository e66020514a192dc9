"""All registered queries and their SQL."""

from __future__ import annotations

from veridock.plans import checks, incremental, judged, logs, places, quantities, star, text  # noqa: F401
from veridock.plans.registry import QUERIES, SQL  # noqa: F401
