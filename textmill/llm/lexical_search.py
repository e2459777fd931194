"""Ranked lexical search over a bit-sliced impact index.

Documents are dealt into blocks where they are read. In a block a term has a bitmap for each
bit of its impacts (the part of a score that the term adds to a document): bit ``s`` of the
impact on document ``p`` is bit ``p`` of slice ``s``. Only those bytes of the bitmaps are kept
that hold a document of the term. Scores of all documents of a block come from bitwise
arithmetic: each term is added by a carry-save adder (sum ``a ^ b ^ c``, carry the majority of
the three, shifted by one slice), and one carry is rippled through at the end. The top k are
found from the most significant slice down: documents with the bit set are better than those
without it, until k are told apart.

The index holds the terms of a query set, or all of them; every document counts in its
statistics either way. Impacts are integers, so scores are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.common import BROADCAST_ROWS, small, table, written

#: A block ends at so many documents (its places are two bytes) or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 32_768, 1_000_000
#: Queries that meet a block of documents at once; query blocks of up to so many terms in all are broadcast.
QUERY_BLOCK = 256

#: Separators of terms become blanks, A-Z lower case; every byte of a character beyond ASCII stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_POSTINGS = "block long, doc_ids array<long>, n array<long>, terms array<string>, df array<int>, places binary, tf binary"
_INDEX = "block long, doc_ids array<long>, terms array<string>, cells array<binary>, slices array<binary>"


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order and with repeats."""
    return raw.translate(FOLD).split()


def term_list(text: Column) -> Column:
    """The same as a column."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def _postings(vocabulary: frozenset[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, found, held, made = [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal ids, n, found, held, made
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))  # places in the order of ids
            names: dict[bytes, int] = {}
            term = np.array([names.setdefault(t, len(names)) for k in order for t in found[k]], dtype=np.int64)
            tf = np.array([c for k in order for c in found[k].values()], dtype=np.uint32)
            place = np.repeat(np.arange(len(order), dtype=np.uint16), [len(found[k]) for k in order])
            by_term = np.argsort(term, kind="stable")
            row = [
                (TaskContext.get().partitionId() << 32) + made, [ids[k] for k in order], [n[k] for k in order], [t.decode() for t in names],
                np.bincount(term, minlength=len(names)).astype(np.int32), place[by_term].astype("<u2").tobytes(), tf[by_term].astype("<u4").tobytes(),
            ]
            ids, n, found, held, made = [], [], [], 0, made + 1
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["block", "doc_ids", "n", "terms", "df", "places", "tf"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = terms_of(text.as_py() or b"")
                counts = Counter(own)
                ids.append(doc_id)
                n.append(len(own))
                found.append(counts if vocabulary is None else {t: c for t, c in counts.items() if t in vocabulary})
                held += len(found[-1])
                if len(ids) == BLOCK_DOCS or held >= BLOCK_POSTINGS:
                    yield block()
        if ids:
            yield block()

    return run


def postings(docs: DataFrame, vocabulary: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each block of documents: their ids and numbers of terms, and of each term
    (of the vocabulary, if there is one) the documents that hold it and how often they do."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(_postings(vocabulary), _POSTINGS)


def slice_up(places: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, slices) of a term: the bytes of a bitmap that hold its places, which ascend, and
    these bytes for each bit of the impacts."""
    cell = places >> 3
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    bits = np.arange(int(impacts.max(initial=0)).bit_length())[:, None]
    lit = ((impacts[None, :] >> bits) & 1).astype(np.uint8) << (places & 7).astype(np.uint8)[None, :]
    return cell[first].astype("<u2"), np.bitwise_or.reduceat(lit, first, axis=1)


def _slices(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            m = np.array([10 + 90 * n * n_docs // n_terms for n in row["n"]], dtype=np.int64)
            ends = np.cumsum(row["df"])
            places, tf = np.frombuffer(row["places"], "<u2").astype(np.int64), np.frombuffer(row["tf"], "<u4").astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[places])
            terms, cells, slices = [], [], []
            for weight in row["weights"]:
                own = slice(ends[weight["at"]] - row["df"][weight["at"]], ends[weight["at"]])
                value = weight["w"] * impact[own]
                if value.any():
                    cell, bits = slice_up(places[own], value)
                    terms.append(row["terms"][weight["at"]])
                    cells.append(cell.tobytes())
                    slices.append(bits.tobytes())
            row = [row["block"], row["doc_ids"], terms, cells, slices]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["block", "doc_ids", "terms", "cells", "slices"])

    return run


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The bit-sliced impact index of ``docs``, as a written table of one row a block.

    ``terms`` (term) are those that will be asked for; without it all terms are indexed. The
    number of terms decides only where the others are left out: up to BROADCAST_ROWS of them
    are known while documents are read, beyond that they meet the postings in a join.
    """
    spark = docs.sparkSession
    vocabulary = None
    if terms is not None:
        terms = terms.select("term").where("term is not null").distinct()
        known = terms.limit(BROADCAST_ROWS + 1).count()
        vocabulary = frozenset(r["term"].encode() for r in terms.toLocalIterator()) if known <= BROADCAST_ROWS else None
    found = written(postings(docs, vocabulary, id_col, text_col), "postings")
    totals = found.select(F.explode("n").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not totals["terms"]:
        return spark.createDataFrame([], _INDEX)
    of_block = found.select("block", F.posexplode(F.arrays_zip("terms", "df")).alias("at", "x")).select("block", "at", F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    df = of_block.groupBy("term").agg(F.sum("df").alias("df"))
    weights = df.select("term", F.floor(1000 * F.log((2.0 * totals["docs"] + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w"))
    if terms is not None and vocabulary is None:
        weights = weights.join(terms, "term", "left_semi")
    # A row of a block: no term is in more rows than there are blocks.
    by_block = of_block.join(small(weights), "term").groupBy("block").agg(F.collect_list(F.struct("at", "w")).alias("weights"))
    return written(found.join(by_block, "block").mapInArrow(_slices(totals["docs"], totals["terms"]), _INDEX), "impacts")


class Block:
    """A block of the index, to be searched."""

    def __init__(self, doc_ids: list[int | None], terms: list[str], cells: list[bytes], slices: list[bytes]):
        self.doc_ids, self.width = doc_ids, -(-len(doc_ids) // 8)
        self.of_term = {}
        for term, cell, bits in zip(terms, cells, slices, strict=True):
            cell = np.frombuffer(cell, "<u2").astype(np.int64)
            self.of_term[term] = cell, np.frombuffer(bits, np.uint8).reshape(-1, len(cell))

    def scores(self, terms: list[str]) -> np.ndarray:
        """The slices of the sums of all terms' impacts, least significant first."""
        own = [self.of_term[t] for t in terms if t in self.of_term]
        height = max((len(bits) for _, bits in own), default=0) + len(own).bit_length()
        total, carry = np.zeros((height, self.width), np.uint8), np.zeros((height, self.width), np.uint8)
        for cell, bits in own:
            where = slice(None) if len(cell) == self.width else cell
            a, c, h = total[:, where], carry[:, where], len(bits)
            either, both = a ^ c, a & c
            both[:h] |= either[:h] & bits
            either[:h] ^= bits
            total[:, where] = either
            carry[1:, where] = both[:-1]
            carry[0, where] = 0
        ripple = np.zeros(self.width, np.uint8)
        for a, c in zip(total, carry, strict=True):
            half = a ^ c
            ripple, a[:] = (a & c) | (half & ripple), half ^ ripple
        return total

    def top(self, terms: list[str], k: int) -> list[tuple[int | None, int]]:
        """The k best (id, score) with a score above 0, equal scores by ascending id."""
        bits = self.scores(terms)
        equal = np.bitwise_or.reduce(bits, axis=0) if len(bits) else np.zeros(self.width, np.uint8)
        better = np.zeros(self.width, np.uint8)
        size = lambda x: int(np.bitwise_count(x).sum())
        if size(equal) <= k:
            better, equal = equal, better
        for one in bits[::-1]:
            with_it = better | (equal & one)
            n = size(with_it)
            if n > k:
                equal = equal & one
            else:
                better, equal = with_it, equal & ~one
                if n == k:
                    break
        places = lambda x: np.flatnonzero(np.unpackbits(x, bitorder="little"))
        best = places(better)
        best = np.r_[best, places(equal)[: k - len(best)]]
        values = ((bits[:, best >> 3] >> (best & 7).astype(np.uint8)) & 1).astype(np.int64).T @ (np.int64(1) << np.arange(len(bits), dtype=np.int64))
        return [(self.doc_ids[p], v) for p, v in zip(best.tolist(), values.tolist(), strict=True)]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            block = Block(row["doc_ids"], row["terms"], row["cells"], row["slices"])
            found = [(item["item_id"], doc_id, score) for item in row["items"] for doc_id, score in block.top(item["words"], k)]
            ids, docs, scores = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, query_terms: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query.

    ``query_terms`` (item_id, term) is dealt into blocks of about QUERY_BLOCK queries, which
    meet every block of the index: by a broadcast if a count proves all query terms few, else
    the index is shuffled once for each query block.
    """
    spark = index.sparkSession
    by_item = query_terms.groupBy("item_id").agg(F.collect_set("term").alias("words"))
    totals = by_item.agg(F.count("*").alias("items"), F.sum(F.size("words")).alias("terms")).first()
    n_blocks = max(1, -(-totals["items"] // QUERY_BLOCK))
    queries = by_item.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).alias("query_block")).agg(F.collect_list(F.struct("item_id", "words")).alias("items"))
    if (totals["terms"] or 0) <= BROADCAST_ROWS:
        queries = F.broadcast(queries)
    pairs = index.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>"))).join(queries, "query_block")
    found = pairs.select("doc_ids", "terms", "cells", "slices", "items").mapInArrow(_search(k), "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query's text.

    Defined cases: a null or empty text has no terms, counts in no statistic and is never
    found; a query without terms, or whose terms no document holds, has no rows; rows of one
    item_id are one query with the terms of all; a term counts once a query; equal scores rank
    by ascending id, null ids last; repeated ids are ranked each for itself; an empty table on
    either side gives an empty result; other columns aren't read.
    """
    words = queries.select(F.col(item_col).cast("long").alias("item_id"), F.explode(term_list(F.col(query_col))).alias("term")).distinct()
    return search(build_index(docs, words, id_col, text_col), words, k)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT docs FROM s) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS impact FROM p JOIN w USING (term) JOIN d USING (doc_id), s),
r AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, doc_id HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
