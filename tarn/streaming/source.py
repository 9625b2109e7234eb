"""A lake as a streaming source: one row for each snapshot, whose id is the stream's offset.

Structured Streaming keeps the offset in its checkpoint, so a stream that is stopped or whose driver is lost goes on where it was.
The rows of a batch's snapshots are read by the batch's own job as ordinary DataFrames (`Lake.insertions`, `deletions`, `changes`).
"""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.lake import Lake


class SnapshotReader(SimpleDataSourceStreamReader):
    """Snapshots after the offset, oldest first, at most `most` a batch. Runs beside the driver, where the store is."""

    def __init__(self, path: str, since: int, most: int):
        self.path, self.since, self.most = path, since, most

    def _rows(self, low: int, high: int | None) -> list[tuple[int]]:
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True, timeout=30)
        try:
            upto = "" if high is None else f"AND snapshot_id <= {int(high)}"
            return db.execute(f"SELECT snapshot_id FROM snapshot WHERE snapshot_id > ? {upto} ORDER BY snapshot_id LIMIT ?", (low, self.most if high is None else -1)).fetchall()
        finally:
            db.close()

    def initialOffset(self) -> dict:
        return {"snapshot": self.since}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._rows(start["snapshot"], None)
        return iter(rows), {"snapshot": rows[-1][0] if rows else start["snapshot"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["snapshot"], end["snapshot"]))


class SnapshotSource(DataSource):
    """Format "tarn_snapshots". Options: path (of the store), since (a snapshot id; -1 for all), most (snapshots a batch)."""

    @classmethod
    def name(cls) -> str:
        return "tarn_snapshots"

    def schema(self) -> str:
        return "snapshot_id long"

    def simpleStreamReader(self, schema):
        return SnapshotReader(self.options["path"], int(self.options.get("since", "-1")), int(self.options.get("most", "1000")))


def snapshots(lake: Lake, since: int = -1, most: int = 1000) -> DataFrame:
    """A streaming DataFrame of the lake's snapshot ids after one."""
    lake.spark.dataSource.register(SnapshotSource)
    return lake.spark.readStream.format("tarn_snapshots").option("path", lake.store.path).option("since", since).option("most", most).load()


def each_window(lake: Lake, table: str, handle: Callable[[DataFrame, int], None], checkpoint: str, since: int = -1, most: int = 1000, trigger: dict | None = None) -> StreamingQuery:
    """Start a stream that calls handle(changes of the table, number of the batch) for each batch of new snapshots.

    A batch that failed after handle() began comes again with the same number and the same changes. With the trigger
    availableNow a run ends after one batch, so `most` bounds what a run handles.
    """

    def batch(rows: DataFrame, number: int) -> None:
        low, high = rows.agg(F.min("snapshot_id"), F.max("snapshot_id")).first()
        if low is not None and lake.store.one("SELECT 1 FROM lake_table WHERE name = ? AND begin_snapshot <= ?", table.rpartition(".")[2], high):
            handle(lake.changes(table, low, high), number)

    return snapshots(lake, since, most).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
