"""SQL access: the marketplace views as session temporary views.

After ``register_views`` the tables can be queried with ``spark.sql`` under
their marketplace names (``products``, ``businesses``, ...), so statements
written for the relational schema run on Spark unchanged in spirit: joins,
GROUP BY, ORDER BY ... LIMIT/OFFSET and correlated scalar subqueries are all
Spark SQL.  Nothing is materialised; each view stays a lazy plan.
"""

from __future__ import annotations

from souq.sources.views import VIEW_NAMES


def register_views(views, names: list[str] | None = None, prefix: str = "") -> list[str]:
    """Register ``views.table(name)`` as ``{prefix}{name}`` for each name; returns the names."""
    names = list(names or (VIEW_NAMES + ["product_text"]))
    for n in names:
        views.table(n).createOrReplaceTempView(prefix + n)
    return [prefix + n for n in names]
