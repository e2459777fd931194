"""SimHash near-duplicates over a Gray-order hierarchical index.

A fingerprint is made of each text where it is read, and equal fingerprints become one
node. Two searches use the index:

``simhash_components`` links fingerprints of 64 bits at a few differing bits, all of them:
nodes within the distance share at least one of the ``distance + 1`` blocks of bits whole, so
each node is sent to the bucket of each of its blocks. A bucket with more than ``bucket_rows``
nodes is split by the blocks of the bits its key doesn't fix; pairs within the distance share
one of those as well, so none is lost.

``near_duplicates`` links texts by the similarity of their shingles. Similar sets differ in too
many bits for blocks that all pairs share, so its fingerprints have eight words of 64 bits, each
node is sent to the buckets of their 16-bit blocks, and what meets there is compared by the
word, then by all bits: a pair of similarity 0.8 misses all of the 32 buckets at 1 in 11, one
of 0.85 at 1 in 45.

In both, a bucket that is still too large is dealt out as pairs of its chunks, so that no task
gets more than twice ``bucket_rows`` and every pair of it is compared.

Within a task the nodes of a bucket are sorted by the Gray rank of their fingerprints,
which puts fingerprints with long common bit patterns side by side. Groups of eight
neighbours form a node of the next level, which holds the bits common to its members and
not yet held above. All fingerprints of a bucket descend the levels together; differences
from the patterns on the way are added up, and a whole group is left as soon as they
exceed the distance. Of the links found only a spanning forest leaves the task.

Components come from alternating large-star and small-star steps over those links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import checkpoint, table

BITS = 64
DISTANCE = 3
SHINGLE_WORDS = 3
BUCKET_ROWS = 4096
FANOUT = 8
#: A bucket is split by blocks this often; one that is still too large, into pairs of chunks.
MAX_SPLITS = 3
#: Shingles whose hashes are held at once.
SHINGLES_AT_ONCE = 1 << 17
#: Pairs of a fingerprint and a group that are compared at once.
FRONTIER = 1 << 20


# ------------------------------------------------------------------ fingerprints


def shingle_hashes(text: str | None, words_in_shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text, repeats included; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    n = max(1, len(words) - words_in_shingle + 1)
    last = end[words_in_shingle - 1 :] if len(words) >= words_in_shingle else end[-1:]
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter([hash_of(joined[a:b], 42) for a, b in zip(begin[:n].tolist(), last.tolist(), strict=True)], dtype=np.uint64, count=n)


_SPREAD = np.array([sum(((byte >> k) & 1) << (8 * k) for k in range(8)) for byte in range(256)], dtype=np.uint64)


def _bit_counts(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(runs, 64): how many hashes of each run of ``n`` (over 0) have each bit set; eight counters
    a word, over at most 255 hashes at a time."""
    parts = -(-n // 255)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(n) - n, parts) + 255 * place
    sums = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], begin, axis=0)
    return np.add.reduceat(sums.view(np.uint8).reshape(-1, BITS).astype(np.int64), np.cumsum(parts) - parts, axis=0)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash made of each hash: itself, then the finaliser of splitmix64 after a step."""
    if not k:
        return hashes
    # The step and multipliers of splitmix64.
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(texts: list[str | None], words_in_shingle: int = SHINGLE_WORDS, n_words: int = 1) -> np.ndarray:
    """(texts, n_words) SimHashes: a bit is 1 if it is set in over half of the shingles' hashes."""
    out = np.zeros((len(texts), n_words), dtype=np.uint64)
    begin = 0
    while begin < len(texts):
        held, end, total = [], begin, 0
        while end < len(texts) and (not held or total < SHINGLES_AT_ONCE):
            held.append(shingle_hashes(texts[end], words_in_shingle))
            total += len(held[-1])
            end += 1
        n = np.array([len(h) for h in held])
        rows = np.flatnonzero(n)
        hashes = np.concatenate(held)
        for k in range(n_words if len(rows) else 0):
            ones = 2 * _bit_counts(_mixed(hashes, k), n[rows]) > n[rows, None]
            out[begin + rows, k] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)[:, 0]
        begin = end
    return out


def _signed(value: np.ndarray) -> np.ndarray:
    return value.astype(np.uint64).view(np.int64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = SHINGLE_WORDS, n_words: int = 1) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; fp holds 64 bits as a signed long, or several words
    of them as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(batch.column(1).to_pylist(), words_in_shingle, n_words)
            fp = pa.array(_signed(found[:, 0])) if n_words == 1 else pa.array([row.tobytes() for row in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    schema = f"doc_id long, fp {'long' if n_words == 1 else 'binary'}"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# ------------------------------------------------------------------ the index


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each 64-bit value in the Gray code's order: the XOR of its prefixes."""
    out = values.astype(np.uint64).copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


class GrayIndex:
    """A tree over fingerprints that are sorted by (bucket, Gray rank).

    ``levels[0]`` are the leaves; a node of level k+1 holds up to eight neighbours of level
    k of one bucket. ``mask`` has the bits that all members share and no ancestor holds,
    ``bits`` their values.
    """

    def __init__(self, fps: np.ndarray, bucket: np.ndarray):
        group = bucket
        shared, values = [np.full(len(fps), ~np.uint64(0))], [fps]
        starts: list[np.ndarray] = []
        while True:
            first = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1]
            if len(first) == len(group):
                break
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
            begin = np.flatnonzero(place % FANOUT == 0)
            ones = np.bitwise_and.reduceat(values[-1] | ~shared[-1], begin)
            any_one = np.bitwise_or.reduceat(values[-1] & shared[-1], begin)
            common = np.bitwise_and.reduceat(shared[-1], begin) & (ones | ~any_one)
            values.append(any_one & common)
            shared.append(common)
            starts.append(np.r_[begin, len(group)])
            group = group[begin]
        self.starts = starts
        self.mask, self.bits = [s.copy() for s in shared], values
        for k in range(len(starts)):
            above = np.repeat(shared[k + 1], np.diff(starts[k]))
            self.mask[k] &= ~above

    def links(self, fps: np.ndarray, top_of: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of leaves of one bucket within the distance."""
        levels = len(self.starts)
        step = max(1, FRONTIER // FANOUT)
        for at in range(0, len(fps), step):
            who = np.arange(at, min(at + step, len(fps)))
            todo = [(levels, who, top_of[who], np.zeros(len(who), dtype=np.uint8))]
            while todo:
                level, q, node, acc = todo.pop()
                acc = acc + np.bitwise_count((fps[q] ^ self.bits[level][node]) & self.mask[level][node])
                near = acc <= distance
                q, node, acc = q[near], node[near], acc[near]
                if level == 0:
                    yield q[q < node], node[q < node]
                    continue
                begin, end = self.starts[level - 1][node], self.starts[level - 1][node + 1]
                n = end - begin
                children = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                q, acc = np.repeat(q, n), np.repeat(acc, n)
                for cut in range(0, len(q), FRONTIER):
                    part = slice(cut, cut + FRONTIER)
                    todo.append((level - 1, q[part], children[part], acc[part]))


def _top_of(index: GrayIndex, n: int) -> np.ndarray:
    top = np.arange(n)
    for start in index.starts:
        top = np.searchsorted(start, top, side="right") - 1
    return top


class Forest:
    """Union-find over array places, linking to the smaller root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        """The root of each place."""
        found = np.array(self.parent)
        while (found[found] != found).any():
            found = found[found]
        return found


def _links(fps: np.ndarray, keys: np.ndarray, distance: int, whole: np.ndarray | None = None, bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of a spanning forest of the pairs within the distance in the buckets ``keys``;
    with ``whole`` (rows, words) only of pairs that differ in ``bits`` bits of all at most."""
    order = np.lexsort((gray_rank(fps), keys))
    index = GrayIndex(fps[order], keys[order])
    forest = Forest(len(fps))
    a, b = [], []
    for i, j in index.links(fps[order], _top_of(index, len(fps)), distance):
        if len(i) > 1000:
            # Of a dense group most pairs are joined already.
            roots = forest.roots()
            new = roots[i] != roots[j]
            i, j = i[new], j[new]
        if whole is not None:
            near = np.bitwise_count(whole[order[i]] ^ whole[order[j]]).sum(axis=1) <= bits
            i, j = i[near], j[near]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if forest.join(x, y):
                a.append(x)
                b.append(y)
    return order[np.array(a, dtype=np.int64)], order[np.array(b, dtype=np.int64)]


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by their first column, in tables that part no bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        # The last bucket may go on in the next batch.
        last = int(np.searchsorted(keys, keys[-1]))
        if last or held and held[-1].column(0)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _bucket_links(distance: int):
    """Links of the buckets in a task; its rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            fps = rows.column(1).to_numpy().view(np.uint64)
            i, j = _links(fps, rows.column(0).to_numpy(), distance)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(fps[i])), pa.array(_signed(fps[j]))], names=["a", "b"])

    return run


def _chunk_pairs(rows: DataFrame, sizes: DataFrame, bucket_rows: int, by: str) -> DataFrame:
    """``rows`` of the buckets in ``sizes(key, count)``, dealt to the pairs of the chunks of their
    bucket: each chunk has about ``bucket_rows``, and each two rows of a bucket meet in a pair."""
    chunks = F.ceil(F.col("count") / bucket_rows).cast("int")
    own = rows.join(sizes.select("key", chunks.alias("_n")), "key").withColumn("_own", F.pmod(F.xxhash64(by, F.lit(7)), F.col("_n")))
    pairs = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    key = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return pairs.withColumn("key", key).drop("_n", "_own", "_other")


def _blocks(free: int, distance: int) -> list[int]:
    """Masks that deal the bits of ``free`` into distance + 1 blocks of near equal width."""
    bits = [k for k in range(BITS) if free >> k & 1]
    n = distance + 1
    return [sum(1 << k for k in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _by_paths(level: DataFrame, masks: list[list[tuple[int, int]]], depth: int) -> DataFrame:
    """(fp, path, key): each fingerprint of ``level(fp, from)`` in a bucket for each (path, mask)
    below the path that it comes from."""
    held = lambda path, mask: F.struct(F.lit(path).alias("path"), F.col("fp").bitwiseAND(F.lit(_long(mask))).alias("bits"))
    options = F.array(*[F.array(*[held(path, mask) for path, mask in below]) for below in masks])
    dealt = level.select("fp", F.explode(F.element_at(options, F.col("from") + 1)).alias("own"))
    return dealt.select("fp", "own.path", F.xxhash64(F.lit(depth), "own.path", "own.bits").alias("key"))


def candidate_buckets(nodes: DataFrame, distance: int, bucket_rows: int) -> DataFrame:
    """(key, fp): each fingerprint of ``nodes(fp)`` with the buckets it is compared in.

    The key is a hash of the path of blocks and of the fingerprint's bits in them; if two
    buckets share a key, more is compared, nothing less.
    """
    fixed = [0]  # the bits that each path fixes
    level, done = nodes.select("fp", F.lit(0).alias("from")), []
    for depth in range(MAX_SPLITS):
        masks, below = [], []
        for bits in fixed:
            blocks = _blocks(((1 << BITS) - 1) & ~bits, distance)
            masks.append([(len(below) + k, bits | block) for k, block in enumerate(blocks)])
            below += [bits | block for block in blocks]
        keyed = _by_paths(level, masks, depth)
        large = checkpoint(keyed.groupBy("key").count().where(F.col("count") > bucket_rows))
        if large.isEmpty():
            done.append(keyed.select("key", "fp"))
            break
        keyed = checkpoint(keyed)
        done.append(keyed.join(large, "key", "left_anti").select("key", "fp"))
        if depth == MAX_SPLITS - 1:
            done.append(_chunk_pairs(keyed.select("key", "fp"), large, bucket_rows, "fp"))
        fixed, level = below, keyed.join(large, "key", "left_semi").select("fp", F.col("path").alias("from"))
    return reduce(DataFrame.unionByName, done)


def near_links(nodes: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs
    within the distance."""
    buckets = candidate_buckets(nodes, distance, bucket_rows)
    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(distance), "a long, b long").distinct()


# ------------------------------------------------------------------ components


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for each node of ``links(a, b)``: the smallest node it can reach.

    Large-star and small-star in turn, until the links don't change. The minimum of a node
    is pre-aggregated, and the join that brings it back to its links can be split where a
    node has many.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        # edges: (u, v) with u the centre whose links are rewired.
        least = checkpoint(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        joined = edges.join(least, "u")
        if large:
            moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    edges = checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        after = checkpoint(star(both, True))
        after = checkpoint(star(after.select(F.col("a").alias("u"), F.col("b").alias("v")), False))
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest doc_id
    reachable over links of at most ``distance`` differing bits.

    Defined cases: a null text, an empty one and one without words have fingerprint zero,
    which links like any other; a text of fewer words than a shingle is one shingle; a null
    id is carried, and a component of null ids only has a null component_id; rows that
    repeat an id each give a row; an empty table gives an empty result; other columns
    aren't read.
    """
    rows = checkpoint(with_fingerprints(docs, id_col, text_col))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(near_links(nodes.select("fp"), distance, bucket_rows))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = checkpoint(rooted)
    ids = checkpoint(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    classes = checkpoint(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


# ------------------------------------------------------------------ by similarity

NEAR_SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Words of 64 bits of a fingerprint; each has four blocks of BAND_BITS bits.
NEAR_WORDS, BAND_BITS = 9, 16


def differing_bits(similarity: float, bits: int, deviations: float = 0.0) -> int:
    """The bits in which fingerprints of sets of that (Jaccard) similarity differ in expectation,
    and so many standard deviations more."""
    p = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    return int(bits * p + deviations * sqrt(bits * p * (1 - p)))


def _similar(similarity: float, n_words: int):
    """Links between nodes of a bucket; rows (key, node, band, fp) come sorted by key."""
    in_word, in_all = differing_bits(similarity, BITS - BAND_BITS, 2.3), differing_bits(similarity, BITS * n_words, NEAR_DEVIATIONS)
    bands = BITS // BAND_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            node, band = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            whole = np.frombuffer(b"".join(rows.column(3).to_pylist()), dtype=np.uint64).reshape(-1, n_words)
            i, j = _links(whole[np.arange(len(node)), band // bands], rows.column(0).to_numpy(), in_word, whole, in_all)
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    return run


#: Standard deviations over the expected bits of the similarity at which a pair still links.
NEAR_DEVIATIONS = 2.5


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words_in_shingle: int = NEAR_SHINGLE_WORDS, similarity: float = SIMILARITY, n_words: int = NEAR_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``; component_id is the smallest doc_id
    reachable over links between texts whose shingles have that similarity or more, as their
    fingerprints of ``64 n_words`` bits tell it.

    Defined cases as in ``simhash_components``.
    """
    rows = checkpoint(with_fingerprints(docs, id_col, text_col, words_in_shingle, n_words))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    step = BAND_BITS // 8
    banded = nodes.select("node", "fp", F.explode(F.sequence(F.lit(0), F.lit(n_words * BITS // BAND_BITS - 1))).alias("band"))
    block = F.expr(f"substring(fp, band * {step} + 1, {step})")
    banded = banded.select(F.xxhash64("band", block).alias("key"), "node", "band", "fp")
    large = checkpoint(banded.groupBy("key").count().where(F.col("count") > bucket_rows))
    if not large.isEmpty():
        banded = banded.join(large, "key", "left_anti").unionByName(_chunk_pairs(banded, large, bucket_rows, "node"))
    links = banded.repartition("key").sortWithinPartitions("key").mapInArrow(_similar(similarity, n_words), "a long, b long").distinct()
    found = nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = checkpoint(found.select("fp", "first_id", "root"))
    ids = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(found.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
