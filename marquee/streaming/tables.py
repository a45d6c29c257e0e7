"""Tables that streams write: upserts with compaction, appended samples, and the ledger of hours.

All are folders of Parquet below one path, in any file system Spark reaches. A table has one writer
at a time, the stream that owns it; readers see whole batches only. A batch that is replayed after
a crash changes nothing, whether the crash came before or after it was published.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from marquee.operators.changes import last_write
from marquee.plans.files import Folder

# An upsert table is compacted when so many deltas lie on its base.
COMPACT_AFTER = 8


class UpsertTable:
    """The newest row of each key, kept by a stream batch by batch.

    `data/` has a base and the deltas of later batches; numbered files in `manifest/` name those that
    count, the highest number the current ones. Publishing the next number is the only
    step that readers see. A compaction writes a new base from base and deltas, so later reads
    open no older file. Replaced folders stay for readers under way until `vacuum`.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: StructType,
        keys: list[str],
        order: list[str],
        compact_after: int = COMPACT_AFTER,
    ) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.order, self.compact_after = keys, order, compact_after
        self._manifest = Folder(spark, f"{path}/manifest")

    def _visible(self) -> list[str]:
        return [n for n in self._manifest.names() if not n.startswith(".")]

    def state(self) -> dict:
        """number, base (or None), deltas, and the last batch in them."""
        names = self._visible()
        if not names:
            return {"number": 0, "base": None, "deltas": [], "batch": -1}
        return json.loads(self._manifest.read(names[-1]))

    def _publish(self, now: dict, **changed) -> None:
        after = {**now, **changed, "number": now["number"] + 1}
        self._manifest.publish(f"{after['number']:012d}", json.dumps(after))

    def _write(self, rows: DataFrame, label: str) -> str:
        name = f"{label}-{uuid.uuid4().hex}"
        rows.select(self.schema.names).write.parquet(f"{self.path}/data/{name}")
        return name

    def start(self, rows: DataFrame) -> None:
        """Take `rows` as the first base, unless the table has begun."""
        now = self.state()
        if not now["number"]:
            self._publish(now, base=self._write(last_write(rows, self.keys, self.order), "base"))

    def append(self, rows: DataFrame, batch: int) -> None:
        """Put a batch on top; one that is in already is left alone."""
        now = self.state()
        if batch <= now["batch"]:
            return
        delta = self._write(last_write(rows, self.keys, self.order), f"delta-{batch}")
        self._publish(now, deltas=[*now["deltas"], delta], batch=batch)
        if len(now["deltas"]) + 1 >= self.compact_after:
            self.compact()

    def compact(self) -> None:
        """One base from all there is."""
        now = self.state()
        if now["deltas"]:
            self._publish(now, base=self._write(self.read(), "base"), deltas=[])

    def folders(self) -> list[str]:
        now = self.state()
        names = [now["base"], *now["deltas"]] if now["base"] else now["deltas"]
        return [f"{self.path}/data/{n}" for n in names]

    def read(self) -> DataFrame:
        """The table as it is now."""
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        # a lone folder has one row per key already
        return rows if len(folders) == 1 else last_write(rows, self.keys, self.order)

    def vacuum(self) -> None:
        """Delete what the current manifest doesn't name; for when nobody reads older states."""
        now = self.state()
        data = Folder(self.spark, f"{self.path}/data")
        for name in data.names():
            if name not in (now["base"], *now["deltas"]):
                data.remove(name)
        for name in self._visible()[:-1]:
            self._manifest.remove(name)


class AppendLog:
    """Rows appended by (run, batch), each batch exactly once.

    A batch is a folder that a replay writes anew, and counts once its marker is there. `run` names
    the job whose batch numbers these are, so that several jobs can feed one log.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self._markers = Folder(spark, f"{path}/committed")

    def _folder(self, name: str) -> str:
        return f"{self.path}/rows/{name}"

    def append(self, rows: DataFrame, run: str, batch: int) -> None:
        name = f"{run}-{batch}"
        if name in self._markers.names():
            return
        rows.select(self.schema.names).write.mode("overwrite").parquet(self._folder(name))
        self._markers.publish(name, "")

    def read(self) -> DataFrame:
        names = [n for n in self._markers.names() if not n.startswith(".")]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*map(self._folder, names))


class Ledger:
    """The latest event time before each batch: what decides which hours are closed for it.

    One small file per batch has the highest time up to and with it, so a replay finds the value
    the first attempt found.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._entries = Folder(spark, path)

    def _batches(self) -> list[int]:
        return sorted(int(n) for n in self._entries.names() if not n.startswith("."))

    def before(self, batch: int) -> int | None:
        earlier = [b for b in self._batches() if b < batch]
        return int(self._entries.read(f"{earlier[-1]:012d}")) if earlier else None

    def note(self, batch: int, highest: int | None) -> None:
        known = [x for x in (self.before(batch), highest) if x is not None]
        if known and batch not in self._batches():
            self._entries.publish(f"{batch:012d}", str(max(known)))
