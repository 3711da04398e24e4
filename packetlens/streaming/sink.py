"""Exactly-once tables of a stream.

``foreachBatch`` may be called again for a batch that was written before a
failure. So each call writes its tables to folders of its own and then publishes them
with one small commit file named after the batch: the commit file's rename is the
moment the batch's rows appear, in all its tables at once. A batch that has been
published isn't written again, so its rows are there once; a reader between batches
sees the last published state and never a table under way. Folders without a commit
are left-overs of failed calls and aren't read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class BatchLog:
    """Tables under ``path`` that grow (or are replaced) batch by batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path(os.path.join(self.path, *parts))

    def publish(self, batch_id: int, tables: dict[str, DataFrame],
                views: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None) -> None:
        """Write the batch's tables, then what ``views`` make of the written tables (so that
        the batch's plan runs once a table), and make all visible together."""
        final = self._at("_commits", f"{batch_id:09d}")
        if self._fs.exists(final):
            return
        call = uuid.uuid4().hex[:12]
        entry, written = {}, {}

        def write(name: str, df: DataFrame) -> None:
            folder = f"{name}/batch-{batch_id:09d}-{call}"
            df.write.parquet(os.path.join(self.path, folder))
            entry[name] = {"folder": folder, "schema": df.schema.json()}
            written[name] = self.spark.read.schema(df.schema).parquet(os.path.join(self.path, folder))

        for name, df in tables.items():
            write(name, df)
        for name, view in (views or {}).items():
            write(name, view(written))
        draft = self._at("_drafts", call)
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self._fs.mkdirs(self._at("_commits"))
        if not self._fs.rename(draft, final):
            raise OSError(f"batch {batch_id} could not be published under {self.path}")

    def batches(self) -> list[int]:
        """The published batches."""
        folder = self._at("_commits")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _entries(self, batch_ids: list[int]) -> list[dict]:
        out = []
        for b in batch_ids:
            f = self._fs.open(self._at("_commits", f"{b:09d}"))
            out.append(json.loads(bytes(f.readAllBytes()).decode()))
            f.close()
        return out

    def read(self, name: str, newest_only: bool = False) -> DataFrame:
        """The published rows of a table; of its newest batch alone if each batch
        brings the whole table (complete mode)."""
        found = [e[name] for e in self._entries(self.batches()) if name in e]
        if not found:
            raise ValueError(f"no batch of {name!r} has been published under {self.path}")
        schema = T.StructType.fromJson(json.loads(found[-1]["schema"]))
        return self.spark.read.schema(schema).parquet(*[os.path.join(self.path, e["folder"]) for e in (found[-1:] if newest_only else found)])
