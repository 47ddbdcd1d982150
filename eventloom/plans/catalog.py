"""All registered queries and their complete oracle texts."""

from . import detection, ledger, merges, messages, normalizers, scalars, streams  # noqa: F401
from . import registry

QUERIES = registry.QUERIES
ORACLES = {name: registry.with_views(sql) for name, sql in registry.ORACLES.items()}
