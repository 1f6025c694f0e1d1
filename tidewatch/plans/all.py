"""All queries of the event model."""

from __future__ import annotations

from tidewatch.plans import catalog, chains, modelled  # noqa: F401  (they register their queries)


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
