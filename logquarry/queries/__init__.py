"""All registered queries; importing this package fills the registry."""

from logquarry.queries import filter_queries, path_queries, source_queries, stream_queries, table_queries  # noqa: F401
from logquarry.queries.registry import ORACLES, QUERIES  # noqa: F401
