"""A sink that adds rows to a collection: ``df.write.format("collection")``.

Each task writes its rows to a file of a new segment and reports it. When all have, files of
attempts that don't count are deleted and the segment is listed by the next state of the
collection's log; when one fails for good, the segment is deleted. So a reader sees all rows of a
write or none. The folder must be on a disk that driver and executors share, as the tasks write
it without Hadoop; for other stores there is ``Collection.add``.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Columns that an entry has.
COLUMNS = ("content", "metadata", "start_line", "end_line", "chunk_no", "vec", "origin")


@dataclass
class Written(WriterCommitMessage):
    """The file of a task, or none if it had no rows."""

    name: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        root, name = options.get("path") or "", options.get("name") or ""
        if not root or not name:
            raise ValueError("Error: the sink needs a path and the name of a collection.")
        if missing := [c for c in COLUMNS if c not in schema.names]:
            raise ValueError(f"Error: entries need the columns {', '.join(missing)}.")
        self.folder, self.overwrite = f"{root.removeprefix('file://').rstrip('/')}/{name}", overwrite
        self.segment = f"segment-{uuid.uuid4().hex}"
        settings = {k: options.get(k) for k in ("embedding_model", "dimensions", "chunk_lines", "overlap")}
        numbers = {"dimensions": None, "chunk_lines": 50, "overlap": 10}
        self.settings = {k: int(v or numbers[k]) if k in numbers else v for k, v in settings.items()} if settings["embedding_model"] and settings["dimensions"] else None
        if self.settings is None and (overwrite or not self._numbers()):
            raise ValueError("Error: a new collection needs embedding_model and dimensions.")

    @property
    def _entries(self) -> str:
        return f"{self.folder}/{self.segment}/entries"

    def _numbers(self) -> list[int]:
        log = f"{self.folder}/log"
        return sorted(int(n.removesuffix(".json")) for n in os.listdir(log) if n.endswith(".json")) if os.path.isdir(log) else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file for the rows of a task; another attempt of it writes another file."""
        name, rows, writer = f"part-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if batch.num_rows:
                    if writer is None:
                        os.makedirs(self._entries, exist_ok=True)
                        writer = pq.ParquetWriter(f"{self._entries}/{name}", batch.schema, compression="snappy")
                    writer.write_batch(batch)
                    rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        kept = {m.name for m in messages if m is not None and m.name}
        for name in os.listdir(self._entries) if os.path.isdir(self._entries) else []:
            if name not in kept:
                os.remove(f"{self._entries}/{name}")
        if not kept and not self.overwrite:
            shutil.rmtree(f"{self.folder}/{self.segment}", ignore_errors=True)
            return
        segment = {"name": self.segment, "parts": ["entries"] if kept else [], "level": 0}
        os.makedirs(f"{self.folder}/log", exist_ok=True)
        made = f"{self.folder}/log/{uuid.uuid4().hex}.tmp"
        while True:
            numbers = self._numbers()
            state = {"segments": [], "batches": {}}
            if numbers and not self.overwrite:
                with open(f"{self.folder}/log/{numbers[-1]:010d}.json", encoding="utf-8") as f:
                    state = json.load(f)
            state = state | {"segments": [*state["segments"], segment], "settings": self.settings or state.get("settings")}
            with open(made, "w", encoding="utf-8") as f:
                json.dump(state, f)
            try:
                # A link to a name that exists fails: another writer was first, so this one adds to its state.
                os.link(made, f"{self.folder}/log/{(numbers[-1] + 1 if numbers else 0):010d}.json")
                return
            except FileExistsError:
                continue
            finally:
                os.remove(made)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(f"{self.folder}/{self.segment}", ignore_errors=True)


class CollectionDataSource(DataSource):
    """Options: path (the folder of collections), name, and for a new or replaced collection
    embedding_model, dimensions, chunk_lines and overlap."""

    @classmethod
    def name(cls) -> str:
        return "collection"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema, overwrite)


def write_collection(spark: SparkSession, entries: DataFrame, root: str, name: str, *, mode: str = "append", **options: str) -> None:
    """Add entries to a collection, or replace it (``overwrite``), in one commit."""
    spark.dataSource.register(CollectionDataSource)
    entries.select(*COLUMNS).write.format("collection").mode(mode).options(path=root, name=name, **options).save()
