"""Nearest vectors: exhaustively in blocks, or by an inverted file of k-means cells.

Entries and queries are packed into block rows, so that a pair of blocks is one matrix product
in a task and neither side is collected. The exhaustive search lets each block of entries meet
each block of queries. The inverted file assigns every entry to its nearest centroid and keeps,
for each cell, blocks of ids with the entries' residuals as bytes. A search reads the blocks of
the cells nearest to a query, takes the best by these codes and scores them again by the
entries' own vectors.

With ``exact`` a second pass makes the answer that of the exhaustive search: the first pass
gives a score that k entries reach, and only those cells and entries are read again and scored
whose centroid, radius and rounding error leave room for as much.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

#: Rows of a block of entries, queries of a block of queries.
ENTRY_BLOCK, QUERY_BLOCK = 4_096, 1_024
#: Bytes of query blocks that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Centroids are fitted on so many rows a cell, at most so many cells and so many bytes of vectors.
ROWS_PER_CELL, MAX_CELLS, SAMPLE_BYTES = 256, 4_096, 256 << 20
#: How many neighbours of how many rows of the sample lie in the cells that a search probes, and the share that must.
CALIBRATED_ROWS, CALIBRATED_K, CALIBRATED_RECALL = 200, 10, 0.96
#: Parts of a cell's blocks, so that a cell that holds a third of all rows isn't one task.
SALTS = 8
#: What a score may differ by from the same score in another order of additions.
ROUNDING = 1e-9


def _matrix(column: pa.Array, dimensions: int | None = None) -> np.ndarray:
    """Vectors of a list column as rows, by its buffers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = dimensions or (len(flat) // len(column) if len(column) else 0)
    if len(flat) != width * len(column):
        raise ValueError("Error: vectors differ in their number of dimensions.")
    return flat.reshape(len(column), width)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the zero vector stays, so that its score is 0."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, entry place, score) of the k best of ``scores`` (entries x queries) for each
    query, ties to the entry that comes first in ``order``."""
    scores = scores[order]
    if len(order) > k:
        # All that are as good as the k-th, of which the sort below takes the first.
        least = np.partition(scores, len(order) - k, axis=0)[len(order) - k]
        place, query = np.nonzero(scores >= least)
    else:
        place, query = (x.ravel() for x in np.indices(scores.shape))
    score = scores[place, query]
    by = np.lexsort((place, -score, query))
    query, place, score = query[by], place[by], score[by]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], order[place[rank < k]], score[rank < k]


def _scaled(metric: str):
    if metric not in ("cosine", "dot"):
        raise ValueError("metric is cosine or dot")
    return _unit if metric == "cosine" else lambda x: x


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, ...]]:
    """Each row's columns as arrays of one element."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.slice(k, 1).columns)


def _source(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(_id, _vec) of the rows that have a vector."""
    return rows.select(F.col(key).alias("_id"), F.col(vec).alias("_vec")).where(F.col("_vec").isNotNull())


def _packed(entries: DataFrame, scaled) -> DataFrame:
    """Block rows (ids, vectors) of ``_source`` rows, the ids in order."""
    schema = StructType([StructField("ids", ArrayType(entries.schema["_id"].dataType)), StructField("vectors", BinaryType()), StructField("width", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ENTRY_BLOCK) for b in batches for k in range(0, b.num_rows, ENTRY_BLOCK)):
            order = pa.compute.sort_indices(batch.column(0))
            matrix = scaled(_matrix(batch.column(1)))[order.to_numpy()]
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0).take(order))
            yield pa.RecordBatch.from_arrays([ids, pa.array([matrix.tobytes()]), pa.array([matrix.shape[1]], pa.int32())], names=["ids", "vectors", "width"])

    return entries.mapInArrow(run, schema)


def _query_blocks(asked: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Query rows as block rows (query_block, queries: array of the rows' other columns)."""
    blocks = max(1, -(-n // QUERY_BLOCK))
    own = [c for c in asked.columns if c not in keys]
    return asked.groupBy(*keys, F.pmod(F.xxhash64("_query"), F.lit(blocks)).alias("query_block")).agg(F.collect_list(F.struct(*own)).alias("queries"))


def _ranked(found: DataFrame, k: int, entry_id: str, query_id: str) -> DataFrame:
    best = Window.partitionBy("_query").orderBy(F.col("_score").desc(), "_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("_query").alias(query_id), F.col("_id").alias(entry_id), F.col("_score").alias("score"), "rank")


def _found_schema(asked: DataFrame, source: DataFrame) -> StructType:
    return StructType([StructField("_query", asked.schema["_query"].dataType), StructField("_id", source.schema["_id"].dataType), StructField("_score", DoubleType())])


def top_k(entries: DataFrame, queries: DataFrame, *, k: int = 10, metric: str = "cosine", vec: str = "vec", entry_id: str = "id", query_id: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
    """(query_id, id, score, rank): the k best entries for each query, ties to the smaller id.

    The queries are a stated set. Their blocks are broadcast if their number and width prove
    them small, else the blocks of entries are shuffled once for each of theirs. A pair of blocks
    passes on only its k best for each query. Entries or queries without a vector are left out,
    a zero vector has the score 0.
    """
    scaled = _scaled(metric)
    source, asked = _source(entries, entry_id, vec), queries.select(F.col(query_id).alias("_query"), F.col(query_vec).alias("_vec")).where(F.col("_vec").isNotNull())
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("_vec")).alias("width")).first()
    blocks = max(1, -(-size["n"] // QUERY_BLOCK))
    packed = _packed(source, scaled)
    asked_blocks = _query_blocks(asked, size["n"])
    if 8 * size["n"] * (size["width"] or 0) <= BROADCAST_BYTES:
        asked_blocks = F.broadcast(asked_blocks)
    pairs = packed.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).join(asked_blocks, "query_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors, width, block in _rows(batches):
            matrix = np.frombuffer(vectors[0].as_py()).reshape(-1, width[0].as_py())
            rows = block.flatten()
            asked = scaled(_matrix(rows.field(1), matrix.shape[1]))
            query, entry, score = _best(matrix @ asked.T, np.arange(len(matrix)), k)
            yield pa.RecordBatch.from_arrays([rows.field(0).take(pa.array(query)), ids.flatten().take(pa.array(entry)), pa.array(score)], names=["_query", "_id", "_score"])

    found = pairs.select("ids", "vectors", "width", "queries").mapInArrow(run, _found_schema(asked, source))
    return _ranked(found, k, entry_id, query_id)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means from rows drawn far from those before; a cell that loses all rows takes the row that fits worst."""
    draw = np.random.default_rng(seed)
    centroids = sample[[draw.integers(len(sample))]]
    nearest = ((sample - centroids[0]) ** 2).sum(axis=1)
    for _ in range(cells - 1):
        total = nearest.sum()
        if total <= 0:
            break
        centroids = np.vstack([centroids, sample[draw.choice(len(sample), p=nearest / total)]])
        nearest = np.minimum(nearest, ((sample - centroids[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own, far = nearest_cell(sample, centroids)
        order = np.argsort(own, kind="stable")
        kept, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        centroids[kept] = sums / np.bincount(own, minlength=len(centroids))[kept, None]
        lost = np.setdiff1d(np.arange(len(centroids)), kept)
        centroids[lost] = sample[np.argsort(-far, kind="stable")[: len(lost)]]
    return centroids


def nearest_cell(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, and the distance to it."""
    own = np.argmin((centroids**2).sum(axis=1)[None, :] - 2 * vectors @ centroids.T, axis=1)
    return own, np.linalg.norm(vectors - centroids[own], axis=1)


def calibrated_probes(sample: np.ndarray, centroids: np.ndarray) -> int:
    """The number of nearest cells that hold CALIBRATED_RECALL of the sample's nearest neighbours
    of some of its rows. Vectors without clusters need most cells, and get them."""
    asked = sample[:CALIBRATED_ROWS]
    own, _ = nearest_cell(sample, centroids)
    _, neighbour, _ = _best(sample @ asked.T, np.arange(len(sample)), CALIBRATED_K)
    query = np.repeat(np.arange(len(asked)), min(CALIBRATED_K, len(sample)))
    far = (centroids**2).sum(axis=1)[None, :] - 2 * asked @ centroids.T
    place = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)[query, own[neighbour]]
    return int(np.quantile(place, CALIBRATED_RECALL, method="higher")) + 1


@dataclass(frozen=True)
class InvertedFile:
    """An inverted file at ``path``, of the vectors of a table. Centroids and radii of its cells
    are in memory: MAX_CELLS of them at most. ``probes`` is how many cells a search reads by default."""

    path: str
    metric: str
    centroids: np.ndarray
    radius: np.ndarray
    probes: int
    entry_type: object

    @property
    def _schema(self) -> StructType:
        return StructType([StructField("cell", IntegerType()), StructField("salt", IntegerType()), StructField("ids", ArrayType(self.entry_type)), StructField("codes", BinaryType()), StructField("scale", DoubleType()), StructField("error", DoubleType()), StructField("radius", DoubleType())])

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self._schema).parquet(f"{self.path}/blocks")

    @staticmethod
    def build(entries: DataFrame, path: str, *, metric: str = "cosine", vec: str = "vec", entry_id: str = "id", cells: int | None = None) -> InvertedFile:
        """Index every entry that has a vector and write the file below ``path``.

        Centroids are fitted on a sample of the rows with the smallest hashes of their ids:
        ROWS_PER_CELL a cell, SAMPLE_BYTES in all at most. By default there are as many cells as
        the square root of the rows, MAX_CELLS at most. Cells are dealt to tasks in SALTS parts.
        """
        scaled, spark = _scaled(metric), entries.sparkSession
        source = _source(entries, entry_id, vec)
        size = source.agg(F.count("*").alias("n"), F.max(F.size("_vec")).alias("width")).first()
        wanted = max(1, min(cells or int(size["n"] ** 0.5), MAX_CELLS, size["n"]))
        rows = max(wanted, min(wanted * ROWS_PER_CELL, SAMPLE_BYTES // (8 * max(1, size["width"] or 1))))
        share = min(1.0, 1.2 * rows / max(1, size["n"]))
        drawn = source.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("_id")).limit(rows)
        sample = scaled(_matrix(drawn.toArrow()["_vec"].combine_chunks())) if size["n"] else np.zeros((0, 0))
        if not len(sample) and size["n"]:
            sample = scaled(_matrix(source.limit(rows).toArrow()["_vec"].combine_chunks()))
        centroids = fit_centroids(sample, wanted) if len(sample) else np.zeros((0, 0))
        probes = calibrated_probes(sample, centroids) if len(sample) else 1
        made = InvertedFile(path, metric, centroids, np.zeros(len(centroids)), probes, source.schema["_id"].dataType)
        if not len(centroids):
            made.blocks_of([], spark).write.mode("overwrite").parquet(f"{path}/blocks")
            return made
        assigned_schema = StructType([StructField("cell", IntegerType()), StructField("_id", made.entry_type), StructField("_vec", source.schema["_vec"].dataType)])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(k, ENTRY_BLOCK) for b in batches for k in range(0, b.num_rows, ENTRY_BLOCK)):
                own, _ = nearest_cell(scaled(_matrix(batch.column(1), centroids.shape[1])), centroids)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], names=["cell", "_id", "_vec"])

        dealt = source.mapInArrow(assign, assigned_schema).withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
        dealt = dealt.repartition("cell", "salt").sortWithinPartitions("cell", "salt")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def block() -> pa.RecordBatch:
                rows = pa.Table.from_batches(held).combine_chunks()
                order = pa.compute.sort_indices(rows["_id"].combine_chunks())
                rows = rows.take(order)
                cell = rows["cell"][0].as_py()
                residual = scaled(_matrix(rows["_vec"].combine_chunks())) - centroids[cell]
                scale = max(float(np.abs(residual).max(initial=0)) / 127, 1e-12)
                codes = np.rint(residual / scale).astype(np.int8)
                error, radius = (float(np.linalg.norm(x, axis=1).max()) for x in (residual - codes * scale, residual))
                ids = pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), rows["_id"].combine_chunks())
                values = [pa.array([cell], pa.int32()), pa.array([rows["salt"][0].as_py()], pa.int32()), ids, pa.array([codes.tobytes()]), *(pa.array([x]) for x in (scale, error, radius))]
                held.clear()
                return pa.RecordBatch.from_arrays(values, names=[f.name for f in made._schema])

            last, n = None, 0
            for batch in batches:
                cell, salt = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                key = cell.astype(np.int64) * SALTS + salt
                cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist() if len(key) else []
                for begin, end in zip(cuts, [*cuts[1:], len(key)], strict=True):
                    if held and key[begin] != last:
                        yield block()
                        n = 0
                    last = key[begin]
                    while begin < end:
                        part = batch.slice(begin, min(end - begin, ENTRY_BLOCK - n))
                        held.append(part)
                        begin, n = begin + part.num_rows, n + part.num_rows
                        if n == ENTRY_BLOCK:
                            yield block()
                            n = 0
            if held:
                yield block()

        dealt.mapInArrow(pack, made._schema).write.mode("overwrite").parquet(f"{path}/blocks")
        radius = np.zeros(len(centroids))
        for row in made.blocks(spark).groupBy("cell").agg(F.max("radius").alias("radius")).toLocalIterator():
            radius[row["cell"]] = row["radius"]
        made = InvertedFile(path, metric, centroids, radius, probes, made.entry_type)
        cells_rows = [(k, c.tolist(), float(r), probes) for k, (c, r) in enumerate(zip(centroids, radius, strict=True))]
        spark.createDataFrame(cells_rows, "cell int, centroid array<double>, radius double, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return made

    def blocks_of(self, rows: list, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(rows, self._schema)

    @staticmethod
    def load(spark: SparkSession, path: str, metric: str = "cosine") -> InvertedFile:
        """A file that ``build`` has written."""
        blocks = spark.read.parquet(f"{path}/blocks")
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        return InvertedFile(path, metric, np.array([r["centroid"] for r in rows]), np.array([r["radius"] for r in rows]), rows[0]["probes"], blocks.schema["ids"].dataType.elementType)

    def _probes(self, asked: DataFrame, probes: int, bounded: bool) -> DataFrame:
        """(_query, _vec, _least, cell): the nearest cells of each query, or those that can hold a score of ``_least``."""
        centroids, radius, scaled = self.centroids, self.radius, _scaled(self.metric)
        schema = StructType([*asked.schema.fields, StructField("cell", IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(k, QUERY_BLOCK) for b in batches for k in range(0, b.num_rows, QUERY_BLOCK)):
                vectors = scaled(_matrix(batch.column(1), centroids.shape[1]))
                if bounded:
                    most = vectors @ centroids.T + np.linalg.norm(vectors, axis=1)[:, None] * radius[None, :]
                    query, cell = np.nonzero(most + ROUNDING >= batch.column(2).to_numpy()[:, None])
                else:
                    far = (centroids**2).sum(axis=1)[None, :] - 2 * vectors @ centroids.T
                    cell = np.argsort(far, axis=1, kind="stable")[:, :probes]
                    query, cell = np.repeat(np.arange(len(vectors)), cell.shape[1]), cell.ravel()
                taken = batch.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32())], names=[f.name for f in schema])

        return asked.mapInArrow(run, schema)

    def _candidates(self, asked: DataFrame, n: int, keep: int, probes: int, bounded: bool) -> DataFrame:
        """(_query, _id): the ``keep`` best by the codes of the probed cells, or all that can reach ``_least``."""
        centroids, scaled, spark = self.centroids, _scaled(self.metric), asked.sparkSession
        salted = self._probes(asked, probes, bounded).withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
        pairs = self.blocks(spark).join(_query_blocks(salted, n, ("cell", "salt")), ["cell", "salt"])
        schema = StructType([asked.schema["_query"], StructField("_id", self.entry_type), StructField("_score", DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell, ids, codes, scale, error, block in _rows(batches):
                rows, centre = block.flatten(), centroids[cell[0].as_py()]
                matrix = centre + np.frombuffer(codes[0].as_py(), np.int8).reshape(-1, len(centre)) * scale[0].as_py()
                vectors = scaled(_matrix(rows.field(1), len(centre)))
                scores = matrix @ vectors.T
                if bounded:
                    most = scores + error[0].as_py() * np.linalg.norm(vectors, axis=1)[None, :]
                    entry, query = np.nonzero(most + ROUNDING >= rows.field(2).to_numpy()[None, :])
                    score = scores[entry, query]
                else:
                    query, entry, score = _best(scores, np.arange(len(matrix)), keep)
                yield pa.RecordBatch.from_arrays([rows.field(0).take(pa.array(query)), ids.flatten().take(pa.array(entry)), pa.array(score)], names=["_query", "_id", "_score"])

        found = pairs.select("cell", "ids", "codes", "scale", "error", "queries").mapInArrow(run, schema)
        if bounded:
            return found.select("_query", "_id")
        best = Window.partitionBy("_query").orderBy(F.col("_score").desc(), "_id")
        return found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= keep).select("_query", "_id")

    def _scored(self, candidates: DataFrame, asked: DataFrame, source: DataFrame) -> DataFrame:
        """Candidates with the scores of their own vectors."""
        scaled = _scaled(self.metric)
        both = candidates.distinct().join(source, "_id").join(asked.select("_query", F.col("_vec").alias("_asked")), "_query").select("_query", "_id", "_vec", "_asked")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b for b in batches if b.num_rows):
                score = np.einsum("ij,ij->i", scaled(_matrix(batch.column(2))), scaled(_matrix(batch.column(3))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score)], names=["_query", "_id", "_score"])

        return both.mapInArrow(run, StructType([both.schema["_query"], both.schema["_id"], StructField("_score", DoubleType())]))

    def search(self, entries: DataFrame, queries: DataFrame, *, k: int = 10, probes: int | None = None, refine: int = 8, exact: bool = False, vec: str = "vec", entry_id: str = "id", query_id: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
        """(query_id, id, score, rank) as of ``top_k``, of the ``probes`` cells nearest to each query
        (by default as many as ``build`` found to be needed, see ``calibrated_probes``).

        The ``refine * k`` best by the codes are scored by the vectors of ``entries``, so entries
        that have gone since the file was built are never found. ``exact`` reads whatever more
        cells and entries can be among the k best of those in the file; scores are then the same
        as those of ``top_k``.
        """
        source = _source(entries, entry_id, vec)
        asked = queries.select(F.col(query_id).alias("_query"), F.col(query_vec).alias("_vec"), F.lit(None).cast("double").alias("_least")).where(F.col("_vec").isNotNull())
        n, probes = asked.count(), probes or self.probes
        if not n or not len(self.centroids):
            return _ranked(entries.sparkSession.createDataFrame([], _found_schema(asked, source)), k, entry_id, query_id)
        found = self._scored(self._candidates(asked, n, refine * k, probes, False), asked, source)
        if exact:
            # A score that k entries reach; a query that found fewer has to look everywhere.
            order = Window.partitionBy("_query").orderBy(F.col("_score").desc())
            reached = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == k).select("_query", F.col("_score").alias("_reached"))
            bounded = asked.join(reached, "_query", "left").select("_query", "_vec", F.coalesce("_reached", F.lit(float("-inf"))).alias("_least"))
            found = self._scored(self._candidates(bounded, n, k, probes, True), asked, source)
        return _ranked(found, k, entry_id, query_id)
