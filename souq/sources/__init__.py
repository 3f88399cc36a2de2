"""Sources: table scans, the marketplace views over the driver tables,
column-dialect handling, seed rows and append/snapshot sinks."""

from souq.sources.tables import scan, scan_jdbc
from souq.sources.views import MarketViews

__all__ = ["scan", "scan_jdbc", "MarketViews"]
