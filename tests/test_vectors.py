"""Exhaustive search and the inverted file."""

import numpy as np
import pytest

from textmill.operators import vectors as V

SF_DIR = "/root/testdata/sf0.1"


def table(spark, matrix, key="id", vec="vec"):
    return spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(matrix)], f"{key} long, {vec} array<float>")


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r[1], round(r["score"], 6)))
    return out


def brute(matrix, asked, k, metric="cosine"):
    a, b = (V._unit(x) if metric == "cosine" else x for x in (np.float32(matrix).astype(float), np.float32(asked).astype(float)))
    scores = a @ b.T
    return {q: [(int(i), round(float(scores[i, q]), 6)) for i in np.lexsort((np.arange(len(a)), -np.round(scores[:, q], 12)))[:k]] for q in range(len(b))}


@pytest.fixture(scope="module")
def clustered():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 24))
    matrix = centres[draw.integers(40, size=6_000)] + 0.35 * draw.normal(size=(6_000, 24))
    matrix[:2_000] = matrix[0]  # a third are one vector
    return matrix


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_the_exact_mode_is_the_exhaustive_search(spark, clustered, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(V, "ENTRY_BLOCK", 256)
    entries, asked = table(spark, clustered), table(spark, clustered[1_990:2_100], "query_id", "query_vec")
    want = {q: [s for _, s in own] for q, own in brute(clustered, clustered[1_990:2_100], 10, metric).items()}
    exhaustive = answers(V.top_k(entries, asked, metric=metric))
    assert {q: [s for _, s in own] for q, own in exhaustive.items()} == want
    cells = V.InvertedFile.build(entries, str(tmp_path / "cells"), metric=metric)
    assert answers(cells.search(entries, asked, exact=True, probes=2)) == exhaustive
    again = V.InvertedFile.load(spark, str(tmp_path / "cells"), metric)
    assert answers(again.search(entries, asked, exact=True, probes=1)) == exhaustive
    assert sum(len(r["ids"]) for r in cells.blocks(spark).collect()) == len(clustered)  # every row is in it
    assert max(len(r["ids"]) for r in cells.blocks(spark).collect()) <= 256


def test_recall_of_the_default_search(spark, tmp_path):
    """Of the vectors of the test data and of random ones, whose cells are the hardest."""
    entries = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vec")
    draw = np.random.default_rng(5)
    for n, rows in enumerate((entries, table(spark, draw.normal(size=(4_000, 16))))):
        queries = rows.where("id % 100 = 0").selectExpr("id AS query_id", "vec AS query_vec")
        cells = V.InvertedFile.build(rows, str(tmp_path / str(n)))
        want, got = answers(V.top_k(rows, queries)), answers(cells.search(rows, queries))
        hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
        assert len(cells.centroids) > 40 and hits >= 0.9 * sum(map(len, want.values()))


def test_entries_that_went_are_not_found(spark, clustered, tmp_path):
    entries, asked = table(spark, clustered), table(spark, clustered[3_000:3_003], "query_id", "query_vec")
    cells = V.InvertedFile.build(entries, str(tmp_path / "c"))
    assert all(i % 2 for own in answers(cells.search(entries.where("id % 2 = 1"), asked)).values() for i, _ in own)


def test_edge_cases(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [0.5, 0.5])]
    entries = spark.createDataFrame(rows, "id long, vec array<float>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, None)], "query_id long, query_vec array<float>")
    cells = V.InvertedFile.build(entries.where("id IS NOT NULL"), str(tmp_path / "a"))
    assert [i for i, _ in answers(cells.search(entries, asked, k=3, exact=True))[7]] == [1, 4, 4]
    empty = V.InvertedFile.build(entries.limit(0), str(tmp_path / "b"))
    assert empty.search(entries, asked).count() == 0 and cells.search(entries, asked.limit(0)).count() == 0
    with pytest.raises(ValueError, match="metric"):
        V.top_k(entries, asked, metric="cos")


def test_many_query_blocks_without_a_broadcast(spark, clustered, monkeypatch):
    entries, asked = table(spark, clustered[:3_000]), table(spark, clustered[2_900:3_000], "query_id", "query_vec")
    want = answers(V.top_k(entries, asked))
    monkeypatch.setattr(V, "QUERY_BLOCK", 16)
    monkeypatch.setattr(V, "BROADCAST_BYTES", 0)
    assert answers(V.top_k(entries, asked)) == want
