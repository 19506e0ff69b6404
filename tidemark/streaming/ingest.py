"""A stream of operations into a store: each micro-batch is one atomic commit.

A micro-batch may come again after a failure; its number stands in the commit, and one that is there is skipped. The
order of operations in a micro-batch is that of the given columns; between micro-batches it is that of arrival. Versions
are given at commit, so late events are simply newer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import LOG
from ..sources.manifest import COMMITS, Manifest
from ..sources.store import Store


def ingest(store: Store, ops: DataFrame, order: list[str], checkpoint: str, name: str = "ingest", once: bool = False) -> StreamingQuery:
    """Starts the query. ops: a streaming DataFrame (op, k, v and the order's columns)."""

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.write_frame(batch, order, batch=(name, number))

    out = ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return (out.trigger(availableNow=True) if once else out).start()


def change_feed(store: Store, handle: Callable[[DataFrame, int], None], checkpoint: str, name: str = "changes", once: bool = False) -> StreamingQuery:
    """Starts a query that follows the store's commits: handle(rows, number) gets the change-log rows that commits added,
    each once; a micro-batch may come again after a failure, with its number. Compactions add nothing. Rows come in once
    their buffer is flushed."""

    def changed(batch: DataFrame, number: int) -> None:
        # a text for each commit since the last micro-batch
        paths = [p for r in batch.select("value").toLocalIterator() for p in Manifest.fresh(r["value"])]
        here = [p for p in paths if store.folder.exists(p)]
        if len(here) < len(paths):
            raise FileNotFoundError(f"{len(paths) - len(here)} tables went before the feed read them: delete_obsolete spares young ones")
        if here:
            handle(store.spark.read.schema(LOG).parquet(*map(store.folder.full, here)), number)

    commits = store.spark.readStream.option("pathGlobFilter", "*.json").text(store.folder.full(COMMITS), wholetext=True)
    out = commits.writeStream.foreachBatch(changed).option("checkpointLocation", checkpoint).queryName(name)
    return (out.trigger(availableNow=True) if once else out).start()
