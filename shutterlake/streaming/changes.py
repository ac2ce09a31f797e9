"""The change feed as a stream: micro-batches are folded and applied to a table of snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.mutations import LATEST, apply_changes, fold, merge_latest
from ..sources.shared import get_text, move_new, put_text, remove

TABLE = "asset_id long, at timestamp_ntz, bytes long"
#: Name of a snapshot's note; readers of Parquet pass over it.
NOTE = "_note.json"


class Position:
    """A position in a feed that is kept in a file: set, read, and cleared, after which there is none."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def set(self, position: int | None) -> None:
        """None clears it. A reader sees the old one, none, or the new one, never half of it."""
        remove(self.spark, self.path)
        if position is not None:
            made = f"{self.path}-{uuid.uuid4().hex}"
            put_text(self.spark, f"{made}/position", str(position))
            move_new(self.spark, made, self.path)
            remove(self.spark, made)

    def get(self) -> int | None:
        said = get_text(self.spark, f"{self.path}/position")
        return None if said is None else int(said)

    def clear(self) -> None:
        self.set(None)


class StaleWriter(RuntimeError):
    """Another writer has published the version that this one was about to."""


class SnapshotTable:
    """A table as numbered Parquet snapshots in one folder: v=0, v=1, ... A reader takes the last one.

    A snapshot is written under a name of its own and becomes a version by one rename that fails where the version exists: of two
    writers one wins, and what the other wrote is deleted. Each carries a note: the feed and batch that it came from, and the
    position in the feed that it began with."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType = TABLE) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v="))

    @property
    def version(self) -> int:
        return max(self._versions(), default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def note(self, version: int | None = None) -> dict:
        """What the snapshot says of its origin; nothing if it says nothing."""
        version = self.version if version is None else version
        if version < 0:
            return {}
        said = get_text(self.spark, f"{self.path}/v={version}/{NOTE}")
        return {} if said is None else json.loads(said)

    def publish(self, rows: DataFrame, version: int, note: dict | None = None) -> bool:
        """rows as that version, if neither it nor a later one is there; whether they are. Nothing is left of rows that come too late."""
        if version <= self.version:
            return False
        made = f"{self.path}/_new-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(made)
            put_text(self.spark, f"{made}/{NOTE}", json.dumps(note or {}))
            return move_new(self.spark, made, f"{self.path}/v={version}")
        finally:
            remove(self.spark, made)

    def prune(self, keep: int = 2) -> None:
        """Delete all but the newest snapshots; readers of those deleted fail."""
        for v in self._versions()[: -max(1, keep)]:
            remove(self.spark, f"{self.path}/v={v}")


def apply_batch(table: SnapshotTable, feed: str = "feed", step: Callable[[DataFrame, DataFrame], DataFrame] = lambda stored, batch: apply_changes(stored, fold(batch))):
    """For foreachBatch. A batch of the feed that comes again after a failure finds itself in the note of the last snapshot and is skipped;
    changes up to the snapshot's position are left out, as it has them. Raises StaleWriter if somebody else published meanwhile."""

    def run(batch: DataFrame, batch_id: int) -> None:
        now = table.version
        note = table.note(now)
        if note.get("feed") == feed and note["batch"] >= batch_id:
            return
        position = note.get("position")
        fresh = batch if position is None else batch.where(F.col("sequence") > position)
        if not table.publish(step(table.read(now), fresh), now + 1, {"feed": feed, "batch": batch_id, "position": position}):
            raise StaleWriter(f"{table.path}: version {now + 1}")

    return run


def apply_stream(changes: DataFrame, table: SnapshotTable, checkpoint: str, every: str | None = None, **how) -> StreamingQuery:
    """Start applying a streaming DataFrame of changes. every: trigger interval (bursts fold into one pass); None: all there is, then stop."""
    writer = changes.writeStream.foreachBatch(apply_batch(table, checkpoint, **how)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rebuild(table: SnapshotTable, scan: DataFrame, position: int | None = None) -> int:
    """The full scan becomes the next version. position: changes up to it are in the scan."""
    version = table.version + 1
    if not table.publish(scan, version, {"position": position}):
        raise StaleWriter(f"{table.path}: version {version}")
    return version


def recover(table: SnapshotTable, feed: DataFrame, scan: Callable[[], DataFrame]) -> int:
    """After the feed's position was lost: a new version from a full scan, and the position to go on from.

    The end of the feed (a static read of it, in order of `sequence`) is taken before the scan begins, so what arrives during the
    scan is past it: apply_stream with a new checkpoint reads the feed from its start, leaves out what is before the position and
    applies the rest. Changes that the scan has seen already are applied once more to the same end."""
    position = feed.agg(F.max("sequence").alias("p")).first().p  # one number
    return rebuild(table, scan(), position)


def deduplicated(changes: DataFrame, late: str = "2 hours") -> DataFrame:
    """A stream of changes without repeated ones (by `sequence`), as long as a repeat is at most `late` behind; state goes after that."""
    return changes.withColumn("_at", F.col("at").cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(["sequence"]).drop("_at")


def apply_any_order(changes: DataFrame, table: SnapshotTable, checkpoint: str, late: str = "2 hours", every: str | None = None) -> StreamingQuery:
    """apply_stream for a feed whose changes come late, out of order or again: table (LATEST) keeps of each asset the change with the
    greatest sequence, deletions too, and so ends the same in any order. Read it with `present`."""
    return apply_stream(deduplicated(changes, late), table, checkpoint, every, step=merge_latest)


def present(table: DataFrame) -> DataFrame:
    """The assets of a LATEST table that are not deleted."""
    return table.where(~F.col("gone")).select("asset_id", "at", "bytes")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Changes per window and operation, for events up to `late` behind; bounded state."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "op").agg(F.count("*").alias("n"))


__all__ = ["LATEST", "Position", "SnapshotTable", "StaleWriter", "apply_any_order", "apply_batch", "apply_stream", "deduplicated", "event_counts", "present", "rebuild", "recover"]
