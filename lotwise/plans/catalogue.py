"""Registry of the engine's named queries and of the SQL that checks them."""

from __future__ import annotations

from lotwise.plans import basics, calibrated, compared, decided, timed  # noqa: F401  each registers its queries

QUERIES: dict = basics.QUERIES
ORACLES: dict[str, str] = basics.ORACLES
