"""The pipeline's stages, and the queries with SQL, on small tables."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from textmill.llm import registry
from textmill.llm.simhash import near_duplicates

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    base = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(900, None, None, "s", 0), (901, "123", "en", "s", 3), (902, "the thing and the other thing", "en", "s", 1), (903, "the  thing and the other thing", "en", "s", 1), (904, "The thing AND the other thing", "en", "s", 1), (902, "the thing and the other thing", "en", "s", 1), (None, "of that and with thering", "en", "s", 1)], base.schema)
    docs = base.unionByName(odd)
    clean = {r["doc_id"] for r in base.collect()}
    kept = corpus_pipeline.language_id(spark, docs, SF_DIR)
    assert kept.columns == COLUMNS
    ids = [r["doc_id"] for r in kept.collect()]
    assert 900 not in ids
    assert 901 not in ids
    assert clean <= set(ids)
    unique = corpus_pipeline.exact_dedup_stage(spark, kept, SF_DIR)
    assert unique.columns == COLUMNS
    texts = ["".join(r["text"].split()) for r in unique.collect()]
    assert len(texts) == len(set(texts))
    ids = [r["doc_id"] for r in unique.collect()]
    assert 903 in ids
    assert 902 not in ids
    assert None in ids
    near = corpus_pipeline.simhash_dedup(spark, unique, SF_DIR)
    assert near.columns == COLUMNS
    assert sorted(i for i in (r["doc_id"] for r in near.collect()) if i and i >= 900) == [903]
    packed = corpus_pipeline.packing(spark, near, SF_DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in near.select("doc_id").collect()}


def test_repeated_ids_keep_one_of_equal_rows(spark):
    docs = spark.createDataFrame([(1, "same text", "en", "s", 1), (1, "same text", "en", "s", 1), (2, "same text", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.exact_dedup_stage(spark, docs, SF_DIR).collect()] == [1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == COLUMNS
        assert docs.count() == 0
    assert corpus_pipeline.packing(spark, docs, SF_DIR).count() == 0


def test_near_copies_of_similarity_over_085_go(spark):
    """All pairs of the stage's own rule on a table with near copies, measured against brute force."""
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet").dropDuplicates(["text"])
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, SF_DIR).collect()}
    texts = {r["doc_id"]: r["text"].lower().split() for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    where, pairs = {}, set()
    for i, own in sets.items():
        for s in own:
            where.setdefault(s, []).append(i)
    for ids in where.values():
        if len(ids) < 50:
            pairs |= {(a, b) for a in ids for b in ids if a < b}
    similar = [p for p in pairs if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) >= 0.85]
    assert similar
    assert not [p for p in similar if p[0] in kept and p[1] in kept]
    clean = set(texts) - {i for p in pairs if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) > 0.4 for i in p}
    assert clean <= kept


def test_recall_at_the_threshold(spark):
    """Of 1,500 pairs with a similarity of 0.80 to 0.85 nine in ten link, of as many of 0.5 none."""
    draw = np.random.default_rng(21)
    texts, kinds = [], []
    while len(kinds) < 3_000:
        base = [f"w{k}" for k in draw.integers(0, 200_000, int(draw.integers(80, 400)))]
        own, wanted = list(base), len(kinds) % 2
        shingles = {tuple(base[k : k + 5]) for k in range(len(base) - 4)}
        for at in draw.permutation(len(own)):
            own[at] = f"x{int(draw.integers(0, 200_000))}"
            other = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
            similar = len(shingles & other) / len(shingles | other)
            if similar < (0.85 if wanted else 0.5):
                break
        if not wanted or similar >= 0.8:
            texts += [" ".join(base), " ".join(own)]
            kinds.append(wanted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    linked = [got[2 * k] == got[2 * k + 1] for k in range(len(kinds))]
    assert sum(x for x, k in zip(linked, kinds, strict=True) if k) >= 0.9 * sum(kinds)
    assert not any(x for x, k in zip(linked, kinds, strict=True) if not k)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "packing"]


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    got = registry.QUERIES[name](spark, SF_DIR)
    cols = sorted(got.columns)
    key = lambda row: tuple(str(x) for x in row)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(key, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(key, want))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
