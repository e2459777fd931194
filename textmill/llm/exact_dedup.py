"""Exact deduplication over a log-structured merge index of text digests.

Each task that reads documents keeps a log-structured tree. A memtable maps a text's digest
to the best row seen so far; when it holds ``memtable_bytes`` of text it is flushed as a run
sorted by digest, with a Bloom filter. A text that the memtable doesn't hold is looked for in
the runs: where all filters exclude its digest it is new, only where one doesn't is the run
searched. What is found there is a hit; its bytes are no longer at hand, so it becomes an entry
of its own, to be verified. When ``FANOUT`` runs have been flushed they are compacted to one of
the next level, and at its end a task compacts all its runs, so that it gives one representative
for each digest, however often the text came; the hits that the runs hold besides are set
apart as its members.

The representatives of all tasks are compacted by digest: the longest original text stays, then
the smallest identifier. The texts of members and of representatives that met others are read
again and their bytes compared with those of the entry kept; entries whose bytes differ (a
digest collision) are compacted again with their whole bytes as the key. What the filters
excluded and no other task holds is never compared.

Only digests are shuffled, and the bytes of hits; never the texts of all documents.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.common import checkpoint, small, table

#: Bytes of white space deleted before texts are compared: [\x20\x09-\x0D].
SPACE_BYTES = b" \t\n\x0b\x0c\r"

MEMTABLE_BYTES = 48 << 20
#: Entries of a group that one verification task compares with a copy of the kept text.
VERIFY_CHUNK = 64
FILTER_BITS_PER_KEY = 10
#: Runs of a level that are compacted to one of the next.
FANOUT = 4
#: Entries of a task's tree, after which it gives out what it has and begins another.
TREE_ENTRIES = 1_000_000

#: Kinds: 0 a row with its entry, 1 a representative, 2 a member of a representative. ``n_rows``
#: are the rows of the entry, ``n_all`` those of a representative with its members.
_LOG = "kind int, uid long, doc_id long, n_cp int, digest binary, entry long, n_rows long, rep long, n_all long"


def normalise(raw: bytes) -> bytes:
    return raw.translate(None, SPACE_BYTES)


def sha256(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


class BloomFilter:
    """Two probes per key, taken from the digest itself, which is already uniform."""

    def __init__(self, digests: list[bytes]):
        self.bits = max(64, len(digests) * FILTER_BITS_PER_KEY)
        self.set = np.zeros(self.bits, dtype=bool)
        for d in digests:
            self.set[self._probes(d)] = True

    def _probes(self, digest: bytes) -> list[int]:
        n = int.from_bytes(digest[:16].ljust(16, b"\0"), "little")
        return [n % self.bits, (n >> 64) % self.bits]

    def __contains__(self, digest: bytes) -> bool:
        return bool(self.set[self._probes(digest)].all())


@dataclass
class Entry:
    """The rows of one text that met in a memtable, as their best row."""

    uid: int
    n_cp: int
    doc_id: int | None
    digest: bytes
    raw: bytes | None  # until the memtable is flushed
    entry: int
    n_rows: int = 1

    def order(self) -> tuple:
        return (-self.n_cp, self.doc_id is None, self.doc_id or 0, self.uid)

    def add(self, uid: int, n_cp: int, doc_id: int | None) -> None:
        self.n_rows += 1
        if (-n_cp, doc_id is None, doc_id or 0, uid) < self.order():
            self.uid, self.n_cp, self.doc_id = uid, n_cp, doc_id


class SortedRun:
    """Entries in the order of their digests, best first, and a filter of the digests."""

    def __init__(self, entries: Iterable[Entry]):
        self.entries = list(entries)
        self.digests = [e.digest for e in self.entries]
        self.filter = BloomFilter(self.digests)

    def __contains__(self, digest: bytes) -> bool:
        if digest not in self.filter:
            return False
        k = bisect_left(self.digests, digest)
        return k < len(self.digests) and self.digests[k] == digest


def compacted(runs: list[SortedRun]) -> SortedRun:
    """One run of several, merged by digest."""
    return SortedRun(merge(*(r.entries for r in runs), key=lambda e: (e.digest, e.order())))


class Tree:
    """A task's memtable and levels of runs."""

    def __init__(self, memtable_bytes: int):
        self.memtable_bytes, self.held = memtable_bytes, 0
        self.memtable: dict[bytes, list[Entry]] = {}
        self.levels: list[list[SortedRun]] = [[]]
        self.size = 0
        self.met: set[bytes] = set()

    def runs(self) -> list[SortedRun]:
        return [run for level in self.levels for run in level]

    def add(self, uid: int, n_cp: int, doc_id: int | None, digest: bytes, raw: bytes) -> int:
        """The number of the entry that the row belongs to, its own or an earlier one's."""
        variants = self.memtable.get(digest)
        for entry in variants or ():
            if entry.raw == raw:
                entry.add(uid, n_cp, doc_id)
                return entry.entry
        # A new entry: the filters of the runs decide whether there is anything to look for.
        if variants or any(digest in run for run in self.runs()):
            self.met.add(digest)
        self.memtable.setdefault(digest, []).append(Entry(uid, n_cp, doc_id, digest, raw, uid))
        self.size += 1
        self.held += len(raw) + 200
        if self.held >= self.memtable_bytes:
            self.flush()
        return uid

    def flush(self) -> None:
        if self.memtable:
            entries = sorted((e for own in self.memtable.values() for e in own), key=lambda e: (e.digest, e.order()))
            for e in entries:
                e.raw = None
            self.levels[0].append(SortedRun(entries))
        self.memtable, self.held = {}, 0
        for k, level in enumerate(self.levels):
            if len(level) >= FANOUT:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(compacted(level))
                self.levels[k] = []

    def groups(self) -> Iterator[list[Entry]]:
        """Entries by digest, best first. Those that nothing met are alone as they are; hits are
        brought together by the order of the compacted run."""
        self.flush()
        for hit, own in groupby(compacted(self.runs()).entries, key=lambda e: e.digest if e.digest in self.met else None):
            if hit is None:
                yield from ([e] for e in own)
            else:
                yield list(own)


def _build_log(digest: Callable[[bytes], bytes], memtable_bytes: int):
    types = {"kind": pa.int32(), "uid": pa.int64(), "doc_id": pa.int64(), "n_cp": pa.int32(), "digest": pa.binary(), "entry": pa.int64(), "n_rows": pa.int64(), "rep": pa.int64(), "n_all": pa.int64()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], names=list(types))

    def given_out(tree: Tree) -> Iterator[pa.RecordBatch]:
        out = []
        for first, *others in tree.groups():
            n = first.n_rows + sum(e.n_rows for e in others)
            out.append((1, first.uid, first.doc_id, first.n_cp, first.digest, first.entry, first.n_rows, first.entry, n))
            out += [(2, e.uid, e.doc_id, e.n_cp, e.digest, e.entry, e.n_rows, first.entry, None) for e in others]
            if len(out) >= 20_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(memtable_bytes)
        for batch in batches:
            uids, ids, sizes = (batch.column(i).to_pylist() for i in (0, 1, 2))
            out = []
            for uid, doc_id, n_cp, text in zip(uids, ids, sizes, batch.column(3).cast(pa.large_binary()), strict=True):
                raw = normalise(text.as_py())
                d = digest(raw)
                out.append((0, uid, doc_id, n_cp, d, tree.add(uid, n_cp, doc_id, d, raw), 1, None, None))
            yield batch_of(out)
            if tree.size >= TREE_ENTRIES:
                yield from given_out(tree)
                tree = Tree(memtable_bytes)
        yield from given_out(tree)

    return run


def _compact(entries: DataFrame, key: str, n: str) -> DataFrame:
    """Merge the runs of all tasks: for each key the entry kept, the rows and the entries of its group.

    A representative stands for all rows of its task with its digest, so the window holds a row
    a task at most.
    """
    group = Window.partitionBy(key)
    best = group.orderBy(F.col("n_cp").desc(), F.col("doc_id").asc_nulls_last(), F.col("uid"))
    return entries.select(
        "entry", "digest", "doc_id", "uid", *([key] if key != "digest" else []),
        F.first(F.struct("doc_id", "uid", "entry")).over(best).alias("keep"),
        F.sum(n).over(group).alias("group_size"),
        F.count("*").over(group).alias("n_entries"),
    )


def _hit_texts(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str, digest: Callable[[bytes], bytes]) -> DataFrame:
    """The normalised bytes of the rows that stand for entries in ``hits``: (entry, raw)."""
    wanted = hits.select(F.col("doc_id").alias("_id")).distinct()
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = found.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches):
        for batch in batches:
            raws = [normalise(t.as_py()) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(digest, raws), pa.binary()), pa.array(raws, pa.binary())], names=["doc_id", "digest", "raw"])

    raw = found.mapInArrow(run, "doc_id long, digest binary, raw binary").dropDuplicates(["doc_id", "digest", "raw"])
    keys = hits.select("entry", F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    return raw.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select("entry", "raw")


def _mismatches(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Entries whose bytes differ from those of the entry kept.

    Members of a group are dealt into chunks by their hash, each with its own copy of the kept
    text, so that no task gets a whole group.
    """
    chunk = F.pmod(F.xxhash64("entry"), F.ceil(F.col("group_size") / VERIFY_CHUNK))
    members = hits.select("entry", F.col("keep.entry").alias("keep_entry"), chunk.alias("chunk"), F.lit(False).alias("is_keep"))
    keeps = members.select(F.col("keep_entry").alias("entry"), "keep_entry", "chunk", F.lit(True).alias("is_keep")).distinct()
    both = members.unionByName(keeps).join(texts, "entry").select("entry", "keep_entry", "chunk", "raw", "is_keep")
    both = both.repartition("keep_entry", "chunk").sortWithinPartitions("keep_entry", "chunk", F.col("is_keep").desc())

    def run(batches):
        at, kept = None, None
        for batch in batches:
            bad = []
            entry, keep, chunk, raw, is_keep = (batch.column(i) for i in range(5))
            for k in range(batch.num_rows):
                group = (keep[k].as_py(), chunk[k].as_py())
                if is_keep[k].as_py():
                    at, kept = group, raw[k].as_py()
                elif group != at or raw[k].as_py() != kept:
                    bad.append(entry[k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], names=["entry"])

    return both.mapInArrow(run, "entry long").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest: Callable[[bytes], bytes] = sha256, memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Two texts are equal if they are identical without the characters [\\x20\\x09-\\x0D]. Of
    equal texts the row with the most code points stays, then the smallest id. Defined
    cases: a null text counts as empty, and empty texts form one group; a null id ranks
    after all others; of rows equal in text and id exactly one stays; an empty table gives
    an empty result; other columns aren't read, whatever their names.
    """
    source = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_cp"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    log = checkpoint(source.mapInArrow(_build_log(digest, memtable_bytes), _LOG))
    rows = log.where("kind = 0").select("uid", "doc_id", "entry", "digest")
    index = checkpoint(_compact(log.where("kind = 1"), "digest", "n_all"))
    members = log.where("kind = 2").join(index.select(F.col("entry").alias("rep"), "keep", "group_size"), "rep")
    members = members.select("entry", "digest", "doc_id", "uid", "keep", "group_size")
    led = log.where("kind = 2").select(F.col("rep").alias("entry")).distinct()
    met = index.where("n_entries > 1").unionByName(index.where("n_entries = 1").join(led, "entry", "left_semi")).drop("n_entries").unionByName(members)
    hits = checkpoint(met)
    index = index.drop("n_entries").unionByName(members)
    texts = _hit_texts(docs, hits, id_col, text_col, digest)
    bad = checkpoint(_mismatches(hits, texts))
    if not bad.isEmpty():
        wrong = hits.join(bad, "entry", "left_semi").select("digest").distinct()
        again = log.where("kind > 0").join(small(wrong), "digest", "left_semi").join(texts, "entry")
        index = index.join(small(wrong), "digest", "left_anti").unionByName(_compact(again, "raw", "n_rows").drop("raw", "n_entries"))
    index = index.select("entry", F.col("keep.doc_id").alias("keep_id"), F.col("keep.uid").alias("keep_uid"), "group_size")
    return rows.join(index, "entry").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "digest")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS raw,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (
  SELECT doc_id, sha256(t) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY length(raw) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
