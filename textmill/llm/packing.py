"""Best-fit packing of tokenised documents with certified bin counts.

Documents become token ids where they are read; a document longer than a sequence is cut,
and only its remainder has to share a sequence. The remainders are dealt into buckets at
random and each bucket is packed best fit decreasing. Dual feasible functions give a lower
bound of the bucket's sequences. A bucket that meets its bound is certified and stays as
it is, but for its emptiest sequence; one with a gap gives up its sequences that aren't
nearly full. What was given up is dealt anew, mixed with that of other buckets, and packed
again, for ``rounds`` rounds or until one bucket holds it all.

Only lengths and checksums are shuffled. A bucket's size is fixed, so no task grows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from textmill.llm.common import checkpoint, table

CAPACITY = 1024
END_ID = 2
BUCKET_ITEMS = 16_384
ROUNDS = 4
#: A sequence of a bucket with a gap stays closed if at most this share of it is empty.
SLACK = 1 / 128

#: Fixed value: the pattern by which a byte-level BPE tokenizer splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """Bytes as a byte-level vocabulary writes them: printable ones as they are, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokenizer:
    """Ids of a byte-level BPE tokenizer file. With ``special_tokens`` a text's parts that spell
    the file's added tokens have those ids, as in the library by default, else they are
    ordinary text.

    The file's merges are in the order of their results' ids, so merging by least id is
    merging by the file; the library used for that takes a third of the time.
    """

    def __init__(self, path: str, special_tokens: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec["pre_tokenizer"], spec["model"]
        if split["type"] != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError("only byte-level BPE without a prefix space or normaliser is supported")
        byte_of, special = _byte_of_char(), {x["content"]: x["id"] for x in spec["added_tokens"]}
        if special_tokens and any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("only added tokens that match as they are written are supported")
        vocabulary = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        results = [vocabulary[a + b] for a, b in merges]
        if results != sorted(results):
            raise ValueError("the merges aren't in the order of their ids")
        ranks = {bytes(byte_of[c] for c in token): k for token, k in vocabulary.items() if token not in special}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special if special_tokens else {})

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=1)
def _loaded(path: str, special_tokens: bool) -> ByteTokenizer:
    """The tokenizer, which a worker process keeps from task to task."""
    return ByteTokenizer(path, special_tokens)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool, special_tokens: bool):
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded(path, special_tokens)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: len(names)]
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = tokenizer.encode(text.as_py() or "") + end
                n = len(raw) // 4
                at, size = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    own = raw[4 * at : 4 * (at + size)]
                    row = (doc_id, piece, at, size, zlib.crc32(own))
                    rows.append((*row, np.frombuffer(own, dtype="<u4").astype(np.int32)) if with_ids else row)
                    at, size = at + size, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, special_tokens: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null text counts as empty and has the end id only.
    """
    run, schema = _pieces(tokenizer_path, capacity, end_id, with_ids, special_tokens)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; an item goes to the fullest bin that can take it."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with room r is open
    made = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            own, room = made, capacity
            made += 1
        bins[k], offsets[k] = own, capacity - room
        room -= size
        if room:
            open_bins[room].append(own)
            rooms |= 1 << room
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int, steps: int = 24) -> int:
    """The largest bound on the bins that the dual feasible functions tried here give.

    These are the identity, the rounding functions x -> floor((k+1)x)/k (x itself where
    (k+1)x is whole), and for each e up to a half the function that counts items above
    1-e as 1 and items below e as 0.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    up = lambda total, unit: -(-int(total) // int(unit))
    best = up((count * size).sum(), capacity)
    for k in range(1, steps + 1):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)
        best = max(best, up((count * value).sum(), k * capacity))
    filled, items = np.cumsum(count * size), np.cumsum(count)
    for e in range(1, capacity // 2 + 1):
        large = items[-1] - items[capacity - e]
        middle = filled[capacity - e] - filled[e - 1]
        best = max(best, up(large * capacity + middle, capacity))
    return best


def _pack_bucket(capacity: int, slack: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n_bins = int(bins.max()) + 1
        room = capacity - np.bincount(bins, weights=lengths, minlength=n_bins).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        if n_bins == bound:
            given_up = np.zeros(n_bins, dtype=bool)
            given_up[room.argmax()] = room.max() > slack
        else:
            given_up = room > slack
        return pdf.assign(bin=bins, offset=offsets, partition_sequences=n_bins, partition_bound=bound, given_up=given_up[bins])

    return run


#: Sequences that a partition made, and the bound under which none could.
CERTIFICATE = ("partition_sequences", "partition_bound")


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, bucket_items: int = BUCKET_ITEMS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """``pieces`` (with a column ``length`` up to ``capacity``) with their sequence_id and offset, and
    of the partition that packed each: its sequences and the bound that it can't be under."""
    others = [c for c in pieces.columns if c != "length"]
    kept = F.struct(*others).alias("_row")
    pieces = checkpoint(pieces.select(kept, F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("_uid")))
    placed = [pieces.where(F.col("length") >= capacity).select("_row", "length", (-1 - F.col("_uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *[F.lit(1).cast("long").alias(c) for c in CERTIFICATE])]
    left = pieces.where(F.col("length") < capacity)
    schema = StructType([*left.schema.fields, *(StructField(c, LongType()) for c in ("_bucket", "bin", "offset", *CERTIFICATE)), StructField("given_up", BooleanType())])
    for k in range(rounds):
        n = left.count()
        if not n:
            break
        buckets = -(-n // bucket_items)
        last = k == rounds - 1 or buckets == 1
        dealt = left.withColumn("_bucket", F.pmod(F.xxhash64("_uid", F.lit(k)), F.lit(buckets)))
        packed = checkpoint(dealt.groupBy("_bucket").applyInPandas(_pack_bucket(capacity, int(capacity * slack)), schema))
        done = packed if last else packed.where(~F.col("given_up"))
        placed.append(done.select("_row", "length", (F.lit(k << 56) + F.shiftleft("_bucket", 24) + F.col("bin")).alias("sequence_id"), "offset", *CERTIFICATE))
        if last:
            break
        left = packed.where("given_up").select("_row", "length", "_uid")
    whole = reduce(DataFrame.unionByName, placed)
    return whole.select("_row.*", "length", "sequence_id", "offset", *CERTIFICATE)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, bucket_items: int = BUCKET_ITEMS, rounds: int = ROUNDS, special_tokens: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row for each piece.

    Columns: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset,
    partition_sequences, partition_bound. A document is its ids and then ``end_id``; only one longer than ``capacity`` is cut, with
    the shorter piece first. Defined cases: a null or empty text is the end id alone; ids
    may be null or repeat, each row is packed by itself; an empty table gives an empty
    result; other columns aren't read. ``special_tokens`` gives the tokenizer's added tokens
    their ids where a text spells them; the query and the pipeline do so.
    """
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, capacity=capacity, end_id=end_id, with_ids=with_ids, special_tokens=special_tokens)
    return pack_pieces(pieces, capacity=capacity, bucket_items=bucket_items, rounds=rounds)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special_tokens=True)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *CERTIFICATE)
