"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

Two texts are compared by the blended spectrum presence kernel: the number of letter n-grams
of 1 to 4 characters that both have, over the root of the numbers each has. Landmark texts
of each language give the Nyström features of a bounded training sample, on which a ridge
regression of one language against the rest is fitted. The kernel is the inner product of
presence vectors, so the landmarks and the coefficients are multiplied into one weight
matrix once, and a batch of texts is scored by one product with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from textmill.llm.common import table

#: Bits of the table that holds the n-grams of 1, 2, 3 and 4 characters.
TABLE_BITS = (11, 13, 14, 14)
WIDTH = sum(1 << b for b in TABLE_BITS)
#: The training sample has at most so many texts of each language, taken by a hash of their
#: ids, and so many of those are landmarks. Each is whole; only its presence bits leave the task.
SAMPLE_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 1e-2
BATCH = 128

UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(k).isalpha() for k in range(0x110000)]))
    return _letters[0]


def gram_places(text: str) -> np.ndarray:
    """Places of a text's n-grams in the table, with repeats; none if it has no letter.

    Letters are in lower case, and whatever lies between words is one blank.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letter_table()[code]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    code = np.where(letter, code, 0)
    code = code[letter | np.r_[True, letter[:-1]]]
    code = np.concatenate([[0], code, [0]]).astype(np.uint32) * np.uint32(0x9E3779B1)
    out, hashed, base = [], code, 0
    for n, bits in enumerate(TABLE_BITS):
        if n:
            hashed = hashed[:-1] * np.uint32(0x85EBCA6B) + code[n:]
            hashed = hashed ^ (hashed >> np.uint32(15))
        out.append((hashed >> np.uint32(32 - bits)).astype(np.int64) + base)
        base += 1 << bits
    return np.concatenate(out)


def presence(texts: list[str | None]) -> np.ndarray:
    """(texts, WIDTH) booleans; a row of a text that is null or has no letter is empty."""
    out = np.zeros((len(texts), WIDTH), dtype=bool)
    for k, text in enumerate(texts):
        if text:
            out[k, gram_places(text)] = True
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (WIDTH, languages)
    bias: np.ndarray | float = 0.0

    @classmethod
    def fit(cls, packed: np.ndarray, labels: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> LanguageModel:
        """Fit to packed presence rows and their labels; the first rows of a label are its landmarks."""
        names = sorted(set(labels))
        label = np.array([names.index(x) for x in labels], dtype=np.int64)
        if len(names) < 2:
            return cls(names, np.zeros((WIDTH, len(names)), dtype=np.float32))
        unpacked = lambda rows: _unit(np.unpackbits(rows, axis=1)[:, :WIDTH].astype(np.float32))
        marks = unpacked(packed[np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(names))])])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        z = np.concatenate([(unpacked(packed[k : k + BATCH]) @ marks.T).astype(np.float64) @ root for k in range(0, len(packed), BATCH)])
        z1 = np.c_[z, np.ones(len(z))]
        y = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
        weight = 1 / np.bincount(label, minlength=len(names))[label]  # each language counts the same
        gram = (z1 * weight[:, None]).T @ z1 + ridge * np.diag(np.r_[np.ones(z.shape[1]), 0])
        coef = np.linalg.solve(gram, (z1 * weight[:, None]).T @ y)
        return cls(names, (marks.T @ (root @ coef[:-1])).astype(np.float32), coef[-1].astype(np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score from 0 to 1."""
        seen = presence(texts)
        known = seen.any(axis=1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        if len(self.languages) == 1:
            return [self.languages[0] if k else UNKNOWN for k in known], known.astype(float)
        value = _unit(seen.astype(np.float32)) @ self.weights + self.bias
        best = value.argmax(axis=1)
        score = np.where(known, np.clip((value[np.arange(len(best)), best] + 1) / 2, 0, 1), 0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score.astype(float)


def fit_language_model(rows: DataFrame, *, sample: int = SAMPLE_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> LanguageModel:
    """Fit to ``rows(doc_id, text, lang)``. Rows with a null lang, text or id aren't learnt from."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((WIDTH, 0), dtype=np.float32))
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    # Half as many again as needed in expectation; what is over is left out below.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 30, int((1 << 30) * 1.5 * sample / n)))])
    picked = rows.withColumn("place", place).where(F.col("place") <= share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, BATCH) for k in range(0, batch.num_rows, BATCH)):
                packed = np.packbits(presence(part.column(2).to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([p.tobytes() for p in packed], pa.binary())], names=["place", "lang", "bits"])

    got = picked.select("place", "lang", "text").mapInArrow(run, "place long, lang string, bits binary").collect()
    got.sort(key=lambda r: (r["lang"], r["place"], r["bits"]))
    taken: dict[str, list] = {}
    for r in got:
        own = taken.setdefault(r["lang"], [])
        if len(own) < sample and any(r["bits"]):
            own.append(r["bits"])
    labels = [lang for lang, own in taken.items() for _ in own]
    bits = [b for own in taken.values() for b in own]
    if not bits:
        return LanguageModel([], np.zeros((WIDTH, 0), dtype=np.float32))
    return LanguageModel.fit(np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), -1), labels, landmarks)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score after its own columns.

    Defined cases: a null text, an empty one and one without letters are ``und`` with score
    0; so is every text if the model has learnt no language; an empty table gives an empty
    result. Columns of ``docs`` named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, BATCH) for k in range(0, batch.num_rows, BATCH)):
                names, scores = model.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is told with ``min_score`` at least, columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, BATCH) for k in range(0, batch.num_rows, BATCH)):
                names, scores = model.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = fit_language_model(docs.where(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
