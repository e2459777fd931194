"""Line deduplication over levelled sorted runs of line hashes, with DataFrame functions only.

Documents are read once for their lines' hashes, which are reduced to the smallest document of
each in its batch; batches are ranges of ids between quantiles, so they are about equal.
``LineRuns`` is the index: a run maps the hash of a line to the smallest document that holds
it, partitioned and sorted by hash (in as many partitions as its size asks for). Each new batch
is merge-anti-joined with the runs there are, and what is left becomes a run of level 0. When a
level holds ``fanout`` runs they are compacted to one run of the next, so that later batches
meet few runs. Batches come in the order of their documents' ids, so the first holder of a line
is the smallest.

Nothing here groups the rows of a line: the runs hold a hash once (partial aggregation first),
and the last step joins each document with the hashes that it keeps, so a line that is in every
document costs no task more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.common import ASCII_SPACE, checkpoint, small, table, written

MIN_CODE_POINTS = 10
BATCHES = 6
FANOUT = 3
#: Lines of a document up to which it is rebuilt on its own row, where each line is looked for
#: in the list of dropped hashes; those of longer documents are dealt out as rows.
LINES_IN_ROW = 2_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of [\\x20\\x09-\\x0D] at both ends, with A-Z in lower case.

    ``lower`` changes other letters too, so it is used only where all characters are ASCII.
    """
    key = F.btrim(line, F.lit(ASCII_SPACE))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _first_hash(line: Column, min_code_points: int) -> Column:
    key = line_key(line)
    return F.when(F.char_length(key) >= min_code_points, F.xxhash64(key))


def _hashes(key: Column, min_code_points: int) -> tuple[Column, Column]:
    """128 bits: XXH64 under two seeds; null for keys that are too short to count."""
    long_enough = F.char_length(key) >= min_code_points
    return F.when(long_enough, F.xxhash64(key)).alias("h1"), F.when(long_enough, F.xxhash64(F.lit(1), key)).alias("h2")


def line_hashes(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """(doc_id, uid, pos, h1, h2) for each line of ``docs(doc_id, uid, text)``."""
    keyed = docs.select("doc_id", "uid", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    return keyed.select("doc_id", "uid", "pos", *_hashes(F.col("key"), min_code_points))


class LineRuns:
    """Levels of sorted runs (h1, h2, doc_id); a hash is in one run at most."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]

    def _run(self, df: DataFrame) -> DataFrame:
        return checkpoint(df.repartition("h1", "h2").sortWithinPartitions("h1", "h2"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Anti-join the batch ``lines(h1, h2, doc_id)``, which has a hash once, with the runs; its
        new hashes become a run."""
        fresh = reduce(lambda new, run: new.join(run, ["h1", "h2"], "left_anti"), self.runs(), lines)
        run = self._run(fresh.select("h1", "h2", "doc_id"))
        self.levels[0].append(run)
        self._compact()
        return run

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                merged = self._run(reduce(DataFrame.unionByName, self.levels[k]))
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.runs())


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_code_points: int = MIN_CODE_POINTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): ``docs`` without the lines an earlier document has.

    A line counts by its key (see ``line_key``); a key of at least ``min_code_points`` keeps
    its lines only in the smallest document that holds it, all of them there. Defined
    cases: a null or empty text is one empty line and stays; rows that repeat an id are one
    document when lines are compared, and each gives its own row; null ids rank last, as
    one document; an empty table gives an empty result; other columns aren't read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with_id = source.where(F.col("doc_id").isNotNull())
    cuts = with_id.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [0.5], 10_000)).first()[0] or []
    batch = reduce(lambda n, cut: n + F.when(F.col("doc_id") > cut, 1).otherwise(0), sorted(set(cuts)) if batches > 1 else [], F.lit(0))
    lines = line_hashes(with_id.withColumn("uid", F.lit(0)), min_code_points).where(F.col("h1").isNotNull())
    lines = lines.groupBy(batch.alias("batch"), "h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    lines = written(lines, "lines", by="batch")
    index = LineRuns(fanout)
    for k in range(len(set(cuts)) + 1 if batches > 1 else 1):
        index.add(lines.where(F.col("batch") == k).select("h1", "h2", "doc_id"))

    # One join by document brings its text and the hashes it keeps together. Within a document
    # the first hash alone tells lines apart.
    of_documents = lambda hashes: hashes.groupBy("doc_id").agg(F.collect_list("h1").alias("own"))
    n_lines = F.size(F.split("text", "\n", -1))
    long = with_id.where((F.octet_length("text") >= LINES_IN_ROW) & (n_lines > LINES_IN_ROW))
    if long.isEmpty():
        whole = _rebuild(with_id.join(of_documents(index.all()), "doc_id", "left"), min_code_points)
    else:
        # Documents of many lines go another way, and their hashes are never one row. An id may be in both.
        short = with_id.where(n_lines <= LINES_IN_ROW)
        only_long = long.select("doc_id").distinct().join(short.select("doc_id"), "doc_id", "left_anti")
        kept = of_documents(index.all().join(small(only_long), "doc_id", "left_anti"))
        whole = _rebuild(short.join(kept, "doc_id", "left"), min_code_points)
        whole = whole.unionByName(_rebuild_long(long, index.all(), min_code_points))
    without_id = source.where(F.col("doc_id").isNull())
    return whole if without_id.isEmpty() else whole.unionByName(_without_id(without_id, index.all(), min_code_points))


def _rebuild(rows: DataFrame, min_code_points: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of ``rows(doc_id, text, own)`` with the hashes kept.

    Sets of hashes are compared first: most documents drop nothing and keep their text as it is.
    """
    lines = rows.select("doc_id", "text", "own", F.split("text", "\n", -1).alias("lines"))
    hashed = lines.withColumn("hashes", F.transform("lines", lambda line: _first_hash(line, min_code_points)))
    nothing = F.array(F.lit(None).cast("long"))
    found = hashed.select("doc_id", "text", "lines", "hashes", F.array_except("hashes", F.coalesce(F.concat("own", nothing), nothing)).alias("gone"))
    keeps = lambda _, k: ~F.coalesce(F.array_contains("gone", F.get("hashes", k)), F.lit(False))
    some = F.size("gone") > 0
    kept = found.select("doc_id", "text", "lines", some.alias("some"), F.when(some, F.filter("lines", keeps)).otherwise(F.col("lines")).alias("kept"))
    return kept.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.when(F.col("some"), F.array_join("kept", "\n")).otherwise(F.col("text")).alias("text"),
    )


def _rebuild_long(docs: DataFrame, index: DataFrame, min_code_points: int) -> DataFrame:
    """The same for documents of many lines, which are joined by document and hash."""
    own = checkpoint(docs.withColumn("uid", F.monotonically_increasing_id()))
    lines = line_hashes(own, min_code_points).where(F.col("h1").isNotNull())
    return _without_places(own, lines.join(index, ["doc_id", "h1", "h2"], "left_anti").select("uid", "pos"))


def _without_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of ``docs(doc_id, uid, text)`` without lines ``places(uid, pos)``.

    The places of a document become a sorted list, which is walked along with the lines.
    """
    gone = places.groupBy("uid").agg(F.array_sort(F.collect_list("pos")).alias("gone"))
    both = docs.join(gone, "uid", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    lines = both.withColumn("lines", F.split("text", "\n", -1)).withColumn("edges", F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines"))))
    # Runs of lines between dropped ones are slices.
    runs = F.transform(F.slice("edges", 1, F.size("gone") + 1), lambda a, k: F.slice("lines", a + 2, F.get("edges", k + 1) - a - 1))
    return lines.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.array_join(F.flatten(runs), "\n").alias("text"),
    )


def _without_id(docs: DataFrame, index: DataFrame, min_code_points: int) -> DataFrame:
    """The same for rows without an id, which rank last and as one document: their lines go where
    a document with an id holds them. Found by hash, so that no task gets all those rows."""
    own = checkpoint(docs.withColumn("uid", F.monotonically_increasing_id()))
    places = line_hashes(own, min_code_points).where(F.col("h1").isNotNull()).join(index.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return _without_places(own, places)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (
  SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) <> doc_id AS dropped FROM k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
