"""Content hashes, their difference to a stored manifest, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_hashes(files: DataFrame, path: str = "rel_path", content: str = "content") -> DataFrame:
    """(path, sha256) of raw bytes or text, lower-case hexadecimal."""
    return files.select(F.col(path).alias("rel_path"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(rel_path, status): added, changed, removed or unchanged; by one full outer join.

    A path is in a manifest at most once; a stored null hash counts as different from any.
    """
    now = current.select("rel_path", F.col("sha256").alias("_now"), F.lit(True).alias("_is"))
    was = manifest.select("rel_path", F.col("sha256").alias("_then"), F.lit(True).alias("_was"))
    both = now.join(was, "rel_path", "full_outer")
    status = (
        F.when(F.col("_is").isNull(), "removed").when(F.col("_was").isNull(), "added")
        .when(F.col("_now").eqNullSafe(F.col("_then")), "unchanged").otherwise("changed")
    )
    return both.select("rel_path", status.alias("status"))


def counts(changes: DataFrame) -> DataFrame:
    """One row: n_changed (with added), n_removed, n_unchanged."""
    return changes.agg(
        F.count_if(F.col("status").isin("added", "changed")).alias("n_changed"),
        F.count_if(F.col("status") == "removed").alias("n_removed"),
        F.count_if(F.col("status") == "unchanged").alias("n_unchanged"),
    )


def kept_entries(entries: DataFrame, changes: DataFrame, path: str = "file_path") -> DataFrame:
    """Entries of files that are neither changed nor removed. Spark broadcasts the changed paths if they are few."""
    dirty = changes.where(F.col("status").isin("changed", "removed", "added")).select(F.col("rel_path").alias("_dirty"))
    return entries.join(dirty, F.col(path) == F.col("_dirty"), "left_anti")


def files_to_chunk(files: DataFrame, changes: DataFrame, path: str = "rel_path") -> DataFrame:
    dirty = changes.where(F.col("status").isin("changed", "added")).select(F.col("rel_path").alias("_dirty"))
    return files.join(dirty, F.col(path) == F.col("_dirty"), "left_semi")


def removed(changes: DataFrame) -> DataFrame:
    """(rel_path) of files that a manifest has and the tree hasn't."""
    return changes.where(F.col("status") == "removed").select("rel_path")


def render_manifest(manifest: DataFrame) -> DataFrame:
    """(rel_path, value): one JSON object a file, in order of paths over all partitions, so that
    written as text it is a list for people that ``parse_manifest`` reads. No task gets all rows."""
    line = F.to_json(F.create_map("rel_path", "sha256"))
    return manifest.select("rel_path", line.alias("value")).orderBy("rel_path")


def parse_manifest(rows: DataFrame, column: str = "value") -> DataFrame:
    """(rel_path, sha256) of JSON objects; what can't be read is an empty manifest."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    return rows.select(F.explode(F.coalesce(parsed, F.create_map().cast("map<string,string>"))).alias("rel_path", "sha256"))
