"""A multi-version, byte-ordered keyspace on Spark: change logs, snapshots, range scans, leveled compaction, repair."""

from .model import LOG, Options
from .operators.batch import WriteBatch
from .sources.repair import repair
from .sources.store import Store, StoreError

__all__ = ["LOG", "Options", "Store", "StoreError", "WriteBatch", "repair"]
