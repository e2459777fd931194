"""A chunk index as Parquet segments with a versioned log, kept up to date with files.

A collection is a folder of segments and a log of numbered states; the state with the highest
number is the current one. A change writes a segment with what is new and the paths whose
earlier rows it makes void, and then commits a state that lists it, so a reader sees the
collection before the change or after it, and a change costs what it changes. A writer claims
its number by creating a file that must not exist, and commits by a rename that fails where
another writer was first; what two writers add at once is both kept.

Segments have levels: ``FANOUT`` neighbours of one level are written as one of the next, so that
a row is written again once a level, as often as the logarithm of the number of changes. States
that were replaced more than ``RETAINED_SECONDS`` ago are deleted with the segments that only
they list, so a reader has at least as long.

The manifest is kept in the segments, outside the tree that is indexed, and the settings of
the embedding model and the chunks in the states.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from textmill.functions.providers import Embedder, HashingEmbedder
from textmill.functions.storage import checkpoint, read_bytes
from textmill.functions.text import preview
from textmill.operators.asked import Answers, StoredEmbedder
from textmill.operators.manifest import counts, diff, file_hashes, files_to_chunk
from textmill.sources.corpus import build_entries, chunk_rows, decode_ignoring, read_corpus

#: Segments of a level that are written as one of the next.
FANOUT = 4
#: How long what a state lists stays readable after the next state.
RETAINED_SECONDS = 86_400.0
#: Changed files up to this number are named to the source, more are found by a join with all.
NAMED_PATHS = 10_000
#: A claim of a number without its state is void after so many seconds.
STALE_CLAIM = 600
_MANIFEST = "rel_path string, sha256 string"


@dataclass(frozen=True)
class IndexSettings:
    embedding_model: str
    dimensions: int
    chunk_lines: int = 50
    overlap: int = 10


def _same_level(segments: list[dict], fanout: int) -> tuple[int, int] | None:
    """The newest run of ``fanout`` neighbours of one level, where a segment has at least the
    level of those after it."""
    levels: list[int] = []
    for s in reversed(segments):
        levels.insert(0, max(s["level"], levels[0] if levels else 0))
    for end in range(len(levels), fanout - 1, -1):
        if len(set(levels[end - fanout : end])) == 1:
            return end - fanout, end
    return None


class Collection:
    """A named index below ``root``, a folder that all executors share, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, name: str | None, retained: float = RETAINED_SECONDS):
        name = name or os.environ.get("COLLECTION_NAME")
        if not name:
            raise ValueError("Error: a collection name is required.")
        self.spark, self.name, self.folder, self.retained = spark, name, f"{root.rstrip('/')}/{name}", retained

    # ---- files of the log, by Hadoop's file system

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self) -> dict[int, float]:
        """The numbers of the log's states in order, with the seconds since each was made."""
        at, fs = self._fs(f"{self.folder}/log")
        found = {f.getPath().getName(): f.getModificationTime() / 1000 for f in fs.listStatus(at)} if fs.exists(at) else {}
        return {int(n.removesuffix(".json")): time.time() - made for n, made in sorted(found.items()) if n.endswith(".json")}

    def _numbers(self) -> list[int]:
        return list(self._listed())

    def _read(self, number: int) -> dict:
        return json.loads(read_bytes(self.spark, f"{self.folder}/log/{number:010d}.json"))

    def _state(self) -> dict | None:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else None

    def _commit(self, change: Callable[[dict | None], dict], tries: int = 20) -> None:
        """Make ``change`` of the newest state the next one; done again where another writer was first."""
        for _ in range(tries):
            numbers = self._numbers()
            number = numbers[-1] + 1 if numbers else 0
            claim, fs = self._fs(f"{self.folder}/log/{number:010d}.claim")
            if not fs.createNewFile(claim):
                if fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_CLAIM:
                    fs.delete(claim, False)
                time.sleep(0.2)
                continue
            state = change(self._read(numbers[-1]) if numbers else None)
            made, _ = self._fs(f"{self.folder}/log/{uuid.uuid4().hex}.tmp")
            out = fs.create(made, True)
            out.write(bytearray(json.dumps(state).encode()))
            out.close()
            committed = self._renamed(made, f"{self.folder}/log/{number:010d}.json")
            fs.delete(claim, False)
            if committed:
                self._clean()
                return
            fs.delete(made, False)  # a writer that took this one's claim for stale was first
        raise RuntimeError(f"Error: other writers keep changing {self.name}.")

    def _renamed(self, made, to: str) -> bool:
        """Rename to a name that must not exist yet; whether it was done."""
        sc = self.spark.sparkContext
        rename = getattr(sc._jvm, "org.apache.hadoop.fs.Options$Rename")
        how = sc._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        at, _ = self._fs(to)
        try:
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), sc._jsc.hadoopConfiguration()).rename(made, at, how)
        except Py4JJavaError as wrong:
            if "FileAlreadyExists" in str(wrong.java_exception.getClass().getName()):
                return False
            raise
        return True

    def _clean(self) -> None:
        """Delete states that were replaced long enough ago, and the segments that only they list."""
        ages = self._listed()
        numbers = list(ages)
        old = [n for n, after in zip(numbers, numbers[1:], strict=False) if ages[after] > self.retained]
        if not old:
            return
        # A segment that a state no longer lists is in none after it.
        kept = {s["name"] for s in self._read(numbers[len(old)])["segments"]}
        for number in old:
            for name in {s["name"] for s in self._read(number)["segments"]} - kept:
                at, fs = self._fs(f"{self.folder}/{name}")
                fs.delete(at, True)
            at, fs = self._fs(f"{self.folder}/log/{number:010d}.json")
            fs.delete(at, False)

    # ---- segments

    def _segment(self, entries: DataFrame | None, manifest: DataFrame | None, gone: DataFrame | None, level: int = 0) -> dict:
        """Write a segment; one that fails leaves nothing behind."""
        name = f"segment-{uuid.uuid4().hex}"
        parts = {"entries": entries, "manifest": manifest, "gone": gone}
        try:
            for part, df in parts.items():
                if df is not None:
                    df.write.parquet(f"{self.folder}/{name}/{part}")
        except Exception:
            at, fs = self._fs(f"{self.folder}/{name}")
            fs.delete(at, True)
            raise
        return {"name": name, "parts": [part for part, df in parts.items() if df is not None], "level": level}

    def _part(self, segments: list[dict], part: str) -> DataFrame | None:
        """A part of all segments, with the place of each row's segment as ``_at``."""
        found = [self.spark.read.parquet(f"{self.folder}/{s['name']}/{part}").withColumn("_at", F.lit(k)) for k, s in enumerate(segments) if part in s["parts"]]
        return reduce(DataFrame.unionByName, found) if found else None

    def _alive(self, segments: list[dict], part: str, path: str) -> DataFrame | None:
        """Rows of a part whose ``path`` no later segment makes void; one join for all segments."""
        rows, gone = self._part(segments, part), self._part(segments, "gone")
        if rows is None or gone is None:
            return rows
        last = gone.groupBy(F.col("rel_path").alias("_path")).agg(F.max("_at").alias("_gone"))
        return rows.join(last, F.expr(path) == F.col("_path"), "left").where("_gone IS NULL OR _at >= _gone").drop("_path", "_gone")

    def exists(self) -> bool:
        return bool(self._numbers())

    def entries(self) -> DataFrame:
        state = self._state()
        if state is None:
            raise ValueError(f"Error: collection {self.name} does not exist.")
        return self._entries(state["segments"])

    def _entries(self, segments: list[dict]) -> DataFrame:
        # Notes have no path here: no file makes them void.
        return self._alive(segments, "entries", "CASE WHEN origin = 'index' THEN metadata.file_path END").drop("_at")

    def manifest(self) -> DataFrame:
        state = self._state()
        found = self._manifest(state["segments"]) if state else None
        return self.spark.createDataFrame([], _MANIFEST) if found is None else found

    def _manifest(self, segments: list[dict]) -> DataFrame | None:
        rows = self._alive(segments, "manifest", "rel_path")
        return None if rows is None else rows.groupBy("rel_path").agg(F.max_by("sha256", "_at").alias("sha256"))

    def settings(self) -> IndexSettings | None:
        state = self._state()
        return None if state is None else IndexSettings(**state["settings"])

    # ---- changes

    def replace(self, entries: DataFrame, manifest: DataFrame, settings: IndexSettings) -> DataFrame:
        """All rows at once, those there were are gone; returns the entries written."""
        segment = self._segment(entries, manifest, None)
        self._commit(lambda _: {"segments": [segment], "settings": asdict(settings), "batches": {}})
        return self.spark.read.parquet(f"{self.folder}/{segment['name']}/entries")

    def add(self, entries: DataFrame, manifest: DataFrame | None = None, gone: DataFrame | None = None, settings: IndexSettings | None = None, batch: tuple[str, int] | None = None) -> DataFrame:
        """More rows, repeats included, after those of the paths in ``gone`` are void; returns the
        entries written. ``batch`` names a stream and the number of its batch, to be remembered."""
        if not self.exists() and settings is None:
            raise ValueError(f"Error: collection {self.name} does not exist.")
        segment = self._segment(entries, manifest, gone)

        def change(state: dict | None) -> dict:
            state = state or {"segments": [], "batches": {}}
            batches = state["batches"] | (dict([batch]) if batch else {})
            return {"segments": [*state["segments"], segment], "settings": asdict(settings) if settings else state["settings"], "batches": batches}

        self._commit(change)
        written = self.spark.read.parquet(f"{self.folder}/{segment['name']}/entries")
        self.compact()
        return written

    def compact(self, fanout: int = FANOUT) -> int:
        """Write neighbours of one level as one segment of the next, as long as there are
        ``fanout`` of them; returns how many segments were written."""
        written = 0
        while (state := self._state()) and (place := _same_level(state["segments"], fanout)):
            begin, end = place
            old = state["segments"][begin:end]
            # Rows of earlier segments stay void by the paths that these make void.
            gone = self._part(old, "gone") if begin else None
            merged = self._segment(self._entries(old), self._manifest(old), None if gone is None else gone.select("rel_path").distinct(), max(s["level"] for s in old) + 1)

            def change(now: dict | None, old: list[dict] = old, merged: dict = merged) -> dict:
                names = [s["name"] for s in now["segments"]]
                at = names.index(old[0]["name"]) if old[0]["name"] in names else -1
                if at < 0 or names[at : at + len(old)] != [s["name"] for s in old]:
                    return now  # another writer has merged or replaced them
                return now | {"segments": [*now["segments"][:at], merged, *now["segments"][at + len(old) :]]}

            self._commit(change)
            written += 1
        return written

    def last_batch(self, stream: str) -> int:
        """The number of the last batch of a stream that was added, or -1."""
        state = self._state()
        return -1 if state is None else state["batches"].get(stream, -1)

    def drop(self) -> None:
        at, fs = self._fs(self.folder)
        fs.delete(at, True)

    def info(self) -> DataFrame:
        """One row: collection, status, points."""
        name = F.lit(self.name).alias("collection")
        if not self.exists():
            return self.spark.range(1).select(name, F.lit("missing").alias("status"), F.lit(0).cast("long").alias("points"))
        return self.entries().agg(F.count("*").alias("points")).select(name, F.lit("ready").alias("status"), "points")


def embed_entries(chunks: DataFrame, embedder: Embedder, origin: str = "index") -> DataFrame:
    """Chunks with their vectors; of a ``StoredEmbedder`` those it hasn't kept yet are made, once each."""
    vec = embedder.embed(F.col("content"))
    if not isinstance(embedder, StoredEmbedder):
        return chunks.select("*", vec.alias("vec"), F.lit(origin).alias("origin"))
    kept = Answers(embedder.folder, ArrayType(FloatType()))
    found = kept.answered(chunks, [F.lit(f"{embedder.name}:{embedder.dimensions}"), F.col("content")], lambda _: vec, F.col("content").isNotNull())
    return found.select(*chunks.columns, F.col("_answer").alias("vec"), F.lit(origin).alias("origin"))


def store_note(collection: Collection, content: str, metadata: dict[str, str], embedder: Embedder = HashingEmbedder()) -> None:
    """A single entry by hand. A sync leaves it alone, even if it names an indexed file."""
    row = collection.spark.range(1).select(
        F.lit(content).alias("content"), F.struct(*[F.lit(metadata.get(k)).cast("string").alias(k) for k in ("file_path", "line_range", "type")]).alias("metadata"),
        F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(0).alias("chunk_no"),
    )
    collection.add(embed_entries(row, embedder, origin="note"))


def _chunks(files: DataFrame, settings: IndexSettings, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """Entries and manifest of ``files(rel_path, content)``, of one and the same reading of each."""
    read = checkpoint(files.select("rel_path", F.col("content").cast("binary").alias("content")))
    chunks = chunk_rows(read.withColumn("text", decode_ignoring("content")), "rel_path", "text", size=settings.chunk_lines, overlap=settings.overlap)
    return embed_entries(chunks, embedder), file_hashes(read)


def type_counts(entries: DataFrame) -> DataFrame:
    """(type, n): entries of each type."""
    return entries.groupBy("metadata.type").agg(F.count("*").alias("n"))


def _check(collection: Collection, settings: IndexSettings) -> None:
    was = collection.settings()
    if was and (was.embedding_model, was.dimensions) != (settings.embedding_model, settings.dimensions):
        raise ValueError(f"Error: {collection.name} holds vectors of {was.embedding_model}, not of {settings.embedding_model}.")


def index_files(collection: Collection, files: DataFrame, *, chunk_lines: int = 50, overlap: int = 10, reset: bool = False, embedder: Embedder = HashingEmbedder()) -> str:
    """Index ``files(rel_path, content)``; without ``reset`` rows are added to those there are.

    A file's hash in the manifest is that of the bytes that were cut, whatever happens to the
    file meanwhile, and the message counts what was written.
    """
    settings = IndexSettings(embedder.name, embedder.dimensions, chunk_lines, overlap)
    if not reset:
        _check(collection, settings)
    entries, manifest = _chunks(files, settings, embedder)
    written = collection.replace(entries, manifest, settings) if reset else collection.add(entries, manifest, settings=settings)
    n = {r["type"]: r["n"] for r in type_counts(written).collect()}
    return f"Indexed {sum(n.values())} chunk(s) into {collection.name}: {n.get('code', 0)} code, {n.get('doc', 0)} doc."


def sync_files(collection: Collection, files: DataFrame, *, chunk_lines: int = 50, overlap: int = 10, embedder: Embedder = HashingEmbedder(), hashes: DataFrame | None = None) -> str:
    """Bring a collection up to the whole of ``files(rel_path, content)``: all are hashed, those
    that changed are cut and written.

    ``hashes(rel_path, sha256)`` are those of ``files``, if its source can make them without the
    contents. Up to NAMED_PATHS changed files are asked for by name, so that a source that takes
    filters on ``rel_path`` over reads only those. Other chunk parameters or a missing collection
    make every file a changed one.
    """
    settings = IndexSettings(embedder.name, embedder.dimensions, chunk_lines, overlap)
    _check(collection, settings)
    was = collection.settings()
    old = collection.manifest()
    known = old if was == settings else old.withColumn("sha256", F.lit(None).cast("string"))
    changes = checkpoint(diff(file_hashes(files) if hashes is None else hashes, known))
    changed, removed, unchanged = counts(changes).first()
    if not changed and not removed and was == settings:
        return f"No changes: {unchanged} file(s) up to date in {collection.name}."
    entries, manifest = _chunks(_named(files, changes, changed), settings, embedder)
    written = collection.add(entries, manifest, changes.where("status IN ('changed', 'removed')").select("rel_path"), settings)
    return f"Synced {collection.name}: {changed} changed, {removed} removed, {unchanged} unchanged; {written.count()} new chunk(s)."


def _named(files: DataFrame, changes: DataFrame, n: int) -> DataFrame:
    """The changed files: by their names if these are few, else by a join."""
    if n > NAMED_PATHS:
        return files_to_chunk(files, changes)
    names = [r["rel_path"] for r in changes.where("status IN ('added', 'changed')").select("rel_path").toLocalIterator()]
    return files.where(F.col("rel_path").isin(names)) if names else files.limit(0)


def upsert_files(collection: Collection, batch: DataFrame, *, chunk_lines: int = 50, overlap: int = 10, embedder: Embedder = HashingEmbedder(), stream: tuple[str, int] | None = None) -> int:
    """Bring ``batch(rel_path, content)`` into a collection and leave other files alone; a null
    content takes its file out. Returns the number of paths that changed.

    Of rows that repeat a path that with the greatest ``seq`` counts, if there is such a column,
    else any. ``stream`` is the name of a stream and the number of its batch: a batch that was
    added before is passed over, so that a repeated one changes nothing.
    """
    if stream and collection.last_batch(stream[0]) >= stream[1]:
        return 0
    settings = IndexSettings(embedder.name, embedder.dimensions, chunk_lines, overlap)
    _check(collection, settings)
    order = F.col("seq") if "seq" in batch.columns else F.lit(0)
    latest = batch.groupBy("rel_path").agg(F.max_by(F.struct(F.col("content").cast("binary").alias("content")), order).alias("row")).select("rel_path", "row.content")
    latest = checkpoint(latest)
    now = latest.where("content IS NOT NULL")
    known = collection.manifest().join(latest.select("rel_path"), "rel_path", "left_semi")
    known = known if collection.settings() in (None, settings) else known.withColumn("sha256", F.lit(None).cast("string"))
    changes = checkpoint(diff(file_hashes(now), known).where("status <> 'unchanged'"))
    n = changes.count()
    if n or stream:
        entries, manifest = _chunks(files_to_chunk(now, changes), settings, embedder)
        collection.add(entries, manifest, changes.where("status IN ('changed', 'removed')").select("rel_path"), settings, stream)
    return n


def _tree(spark: SparkSession, root: str, options: dict[str, str]) -> DataFrame:
    return read_corpus(spark, root, **options).where(F.col("error").isNull())


def index_repo(collection: Collection, root: str, *, chunk_lines: int = 50, overlap: int = 10, reset: bool = False, embedder: Embedder = HashingEmbedder(), **options: str) -> str:
    """Index a whole tree; without ``reset`` rows are added to those there are."""
    return index_files(collection, _tree(collection.spark, root, options), chunk_lines=chunk_lines, overlap=overlap, reset=reset, embedder=embedder)


def sync_repo(collection: Collection, root: str, *, chunk_lines: int = 50, overlap: int = 10, embedder: Embedder = HashingEmbedder(), **options: str) -> str:
    """Bring a collection up to date with a tree. Every file is streamed through SHA-256 once;
    only changed ones are opened once more, read and cut."""
    files, hashes = (_tree(collection.spark, root, options | more) for more in ({}, {"digest": "true"}))
    return sync_files(collection, files, chunk_lines=chunk_lines, overlap=overlap, embedder=embedder, hashes=hashes.select("rel_path", "sha256"))


def preview_entries(entries: DataFrame, limit: int = 10, one_line: bool = True) -> DataFrame:
    """The first entries by path and line, shortened."""
    first = entries.orderBy("metadata.file_path", "start_line").limit(limit)
    return first.select("metadata.file_path", "metadata.line_range", "metadata.type", preview("content", one_line=one_line).alias("preview"))


def preview_index(spark: SparkSession, root: str, *, limit: int = 10, chunk_lines: int = 50, overlap: int = 10, **options: str) -> tuple[int, DataFrame]:
    """The number of chunks and the first of them, nothing written."""
    entries = build_entries(spark, root, size=chunk_lines, overlap=overlap, **options)
    return entries.count(), preview_entries(entries, limit)
