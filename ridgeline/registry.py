"""All queries of the terrain engine and their SQL."""

from __future__ import annotations

from ridgeline.plans import accounts, arrival, base, ground, mapping, merit, overlay, physics, search  # noqa: F401  (modules register their queries)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
