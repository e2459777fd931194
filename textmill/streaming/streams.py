"""Structured Streaming over arriving events and file snapshots."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textmill.functions.providers import Embedder, HashingEmbedder, Reachability
from textmill.operators.events import allowed, command_of, command_route, web_route
from textmill.operators.index import Collection, upsert_files
from textmill.sources.corpus import read_corpus_stream

EVENT_SCHEMA = "tool_name string, tool_input string, tool_response string"


def route_events(raw: DataFrame, column: str = "value", reachable: bool | Reachability = True, observation: str | Observation | None = None) -> DataFrame:
    """One decision for each event, without state: (tool_name, web, command, condense).

    Works on batches and streams alike. What isn't an event is dropped, as a hook that can't
    read its input lets the tool go on; ``observation``, or a name for a stream's listeners,
    gets the numbers of rows ``read`` and of those ``unreadable``.
    """
    event = F.from_json(F.col(column), EVENT_SCHEMA)
    rows = raw.select(event.alias("e"))
    if observation is not None:
        rows = rows.observe(observation, F.count(F.lit(1)).alias("read"), F.count_if(F.col("e.tool_name").isNull()).alias("unreadable"))
    rows = rows.where(F.col("e.tool_name").isNotNull()).select("e.*")
    tool = F.col("tool_name")
    return rows.select(
        "tool_name", web_route(tool, F.get_json_object("tool_input", "$.url"), F.get_json_object("tool_input", "$.prompt"), reachable).alias("web"),
        command_route(command_of(F.col("tool_input"))).alias("command"), allowed(tool, F.col("tool_response")).alias("condense"),
    )


def sync_stream(files: DataFrame, collection: Collection, checkpoint: str, *, chunk_lines: int = 50, overlap: int = 10, embedder: Embedder = HashingEmbedder()) -> StreamingQuery:
    """Keep a collection up to date with a stream of ``(rel_path, content)``, where a null content
    takes a file out and the greatest ``seq`` of a path counts, if there is such a column.

    The manifest is the state: a file that comes again unchanged costs a look-up. Each batch is
    committed with its number under the stream's checkpoint folder, so a batch that is repeated
    after a failure changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        own = Collection(batch.sparkSession, collection.folder.rpartition("/")[0], collection.name)
        upsert_files(own, batch, chunk_lines=chunk_lines, overlap=overlap, embedder=embedder, stream=(checkpoint, number))

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_tree(spark: SparkSession, root: str, collection: Collection, checkpoint: str, *, chunk_lines: int = 50, overlap: int = 10, embedder: Embedder = HashingEmbedder(), **options: str) -> StreamingQuery:
    """Keep a collection up to date with a tree on the driver's and the executors' disks: each run
    takes what changed since the last one. Listings of the tree are kept below ``checkpoint``.
    A file that can't be read stays as it was in the collection."""
    state = os.path.join(checkpoint.removeprefix("file://"), "listings")
    changes = read_corpus_stream(spark, root, state, **options).where(F.col("error").isNull())
    return sync_stream(changes.select("rel_path", "content"), collection, checkpoint, chunk_lines=chunk_lines, overlap=overlap, embedder=embedder)
