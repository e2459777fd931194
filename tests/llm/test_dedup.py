"""Exact, line and near-duplicate operators against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textmill.llm import exact_dedup as E
from textmill.llm import line_dedup as L
from textmill.llm import simhash as S

SPACES = " \t\n\x0b\x0c\r"
DOCS = [
    (5, "a b"), (3, "ab"), (9, "a  b"), (2, "a b"), (7, None), (8, ""), (4, " \t\n"), (1, "x" * 50_000), (6, "x" * 50_000 + "\n"), (None, "ab"), (10, "ab"), (10, "ab"), (11, "日本 語"), (12, "日本語"),
]
EXTRA = ", digest string, uid long, keep string"


def frame(spark, docs=DOCS, partitions=3):
    rows = [(i, t, "d", 1, "k") for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string" + EXTRA).repartition(partitions)


def exact_brute(docs):
    rows = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in docs]
    out = []
    for i, _, key in rows:
        own = [r for r in rows if r[2] == key]
        best = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out.append((i, best[0], len(own)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("digest", "memtable"), [(E.sha256, 1 << 20), (E.sha256, 1), (lambda raw: bytes([len(raw) % 2]) * 32, 1 << 20), (lambda raw: b"\0" * 32, 1)])
def test_exact(spark, digest, memtable):
    """With weak digests all hits collide, and only the comparison of bytes tells texts apart."""
    got = E.exact_dedup(frame(spark), digest=digest, memtable_bytes=memtable).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == exact_brute(DOCS)
    groups = {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in DOCS}
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_empty(spark):
    got = E.exact_dedup(frame(spark, []))
    assert got.count() == 0
    assert got.columns[:4] == ["doc_id", "keep_id", "group_size", "kept"]


def entry(digest, uid):
    return E.Entry(uid, 1, uid, digest, None, uid)


def test_filter_and_run():
    digests = sorted(E.sha256(bytes([k])) for k in range(200))
    run = E.SortedRun(entry(d, k) for k, d in enumerate(digests[:100]))
    assert all(d in run for d in digests[:100])
    assert not any(d in run for d in digests[100:])
    assert sum(d in run.filter for d in digests[100:]) < 20


def test_tree_against_a_dictionary():
    """Representatives and members, whatever is flushed when; and what the filters decide is used."""
    rng = np.random.default_rng(3)
    texts = [bytes([65 + int(k)]) * (1 + int(k)) for k in rng.integers(0, 40, 300)]
    for memtable in (1, 1000, 1 << 30):
        tree = E.Tree(memtable)
        found = [tree.add(k, len(t), k, E.sha256(t), t) for k, t in enumerate(texts)]
        groups = list(tree.groups())
        assert max(len(level) for level in tree.levels) < E.FANOUT
        assert {own[0].digest for own in groups} == {E.sha256(t) for t in texts}
        assert len(groups) == len(set(texts))
        for own in groups:
            mine = [k for k, t in enumerate(texts) if E.sha256(t) == own[0].digest]
            assert (own[0].doc_id, sum(e.n_rows for e in own)) == (min(mine), len(mine))
            assert {e.entry for e in own} == {found[k] for k in mine}
            assert len(own) == 1 or own[0].digest in tree.met
    blind = E.Tree(1)
    blind.runs = lambda: []  # no filter is asked: nothing would be brought together
    for k in range(2):
        blind.add(k, 1, k, E.sha256(b"x"), b"x")
    assert not blind.met


LINES = [
    (1, "Same line here\nother"), (2, "  SAME LINE HERE \nsame line here\nshort\nown line of two"), (3, "short\nsame line here"), (4, None), (5, ""), (6, "\n\n"), (7, "own line of two"),
    (8, "unique line eight\nunique line eight"), (None, "same line here\nnull only line"), (None, "null only line"), (9, "ÄÖÜ äöü line nine"), (10, "äöü äöü line nine"), (11, "äÖÜ äöü line NINE\nÄÖÜ äöü line NINE "), (12, "0123456789"), (13, "0123456789\n012345678"), (14, "012345678"), (12, "again"),
]


def lines_brute(docs):
    lower = {k: k + 32 for k in range(65, 91)}
    key = lambda line: line.strip(SPACES).translate(lower)
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), i), i, key=order)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_lines(spark, batches, fanout):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in LINES], "doc_id long, text string, h1 long, pos long").repartition(3)
    got = L.line_dedup(docs, batches=batches, fanout=fanout).collect()
    assert sorted((tuple(r) for r in got), key=str) == lines_brute(LINES)


def test_lines_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_dedup(docs).count() == 0


def test_runs_compact(spark):
    runs = L.LineRuns(fanout=2)
    for k in range(4):
        runs.add(spark.range(k, k + 3).select(F.lit(k).cast("long").alias("doc_id"), F.col("id").alias("h1"), F.col("id").alias("h2")))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert sorted(tuple(r) for r in runs.all().select("h1", "doc_id").collect()) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 3)]


def test_null_ids_and_repeats(spark):
    """Rows without an id are one document that ranks last, in the brute force above; here with many of them."""
    rng = np.random.default_rng(5)
    pool = [f"line number {k} of the pool" for k in range(30)] + ["short", ""]
    docs = [(None if rng.random() < 0.3 else int(rng.integers(0, 40)), "\n".join(pool[int(k)] for k in rng.integers(0, len(pool), int(rng.integers(0, 9))))) for _ in range(150)]
    docs.append((2**63 - 1, pool[0] + "\nthe last id's own line"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in L.line_dedup(df).collect()), key=str) == lines_brute(docs)


def test_documents_of_many_lines(spark, monkeypatch):
    monkeypatch.setattr(L, "LINES_IN_ROW", 1)
    df = spark.createDataFrame(LINES, "doc_id long, text string")
    assert sorted((tuple(r) for r in L.line_dedup(df).collect()), key=str) == lines_brute(LINES)


def simhash_brute(t):
    words = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "one TWO", "a b c", "a b c a b c a b c", "Ä ä Ü é", "x " * 3000, "one two three four five six seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in S.with_fingerprints(docs).collect()}
    assert got == {k: simhash_brute(t) for k, t in enumerate(texts)}


def planted(seed=0, groups=60):
    rng = np.random.default_rng(seed)
    out = []
    for base in rng.integers(0, 1 << 63, groups, dtype=np.uint64):
        x = int(base)
        for _ in range(int(rng.integers(1, 12))):
            out.append(x)
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(b)
    return sorted(set(out))


def components_brute(fps, distance=3):
    parent = list(range(len(fps)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(k) for k in range(len(fps))]


@pytest.mark.parametrize("bucket_rows", [2, 8, 10_000])
def test_links_keep_all_components(spark, bucket_rows):
    fps = planted()
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = S.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket_rows=bucket_rows)
    got = {r["node"]: r["root"] for r in S.components(links).collect()}
    want = components_brute(fps)
    label = {}
    for x, c in zip(signed, want, strict=True):
        label.setdefault(c, []).append(x)
    for own in label.values():
        roots = {got.get(x, x) for x in own}
        assert roots == {min(own)}


def test_index_finds_all_pairs():
    fps = np.array(planted(1), dtype=np.uint64)
    bucket = (fps % np.uint64(3)).astype(np.int64)
    order = np.lexsort((S.gray_rank(fps), bucket))
    fps, bucket = fps[order], bucket[order]
    index = S.GrayIndex(fps, bucket)
    got = {(int(a), int(b)) for i, j in index.links(fps, S._top_of(index, len(fps)), 3) for a, b in zip(i, j, strict=True)}
    assert got == {(i, j) for j in range(len(fps)) for i in range(j) if bucket[i] == bucket[j] and int(fps[i] ^ fps[j]).bit_count() <= 3}


def test_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in S.components(links).collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000}
    assert S.components(links.limit(0)).count() == 0


def test_components_of_documents(spark):
    docs = [(3, "one two three four"), (2, "One two THREE four"), (None, "one two three four"), (5, None), (9, " "), (8, "quite another text it is"), (8, "quite another text it is"), (None, "only null here at all")]
    rows = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, fp int, root int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.simhash_components(rows).collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (None, 2), (5, 5), (9, 5), (8, 8), (8, 8), (None, None)], key=str)
    assert S.simhash_components(rows.limit(0)).count() == 0


def shingle_sets(texts, n=5):
    return [{" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in (t.lower().split() for t in texts)]


@pytest.mark.parametrize("bucket_rows", [4, 4096])
def test_near_duplicates_against_brute_force(spark, bucket_rows):
    """Pairs of 0.85 or more are in one component, and no component joins what is far apart."""
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(25):
        base = [f"w{k}" for k in rng.integers(0, 5000, int(rng.integers(60, 300)))]
        for _ in range(int(rng.integers(1, 6))):
            own = list(base)
            for at in rng.integers(0, len(own), int(rng.integers(0, 4))):
                own[int(at)] = f"x{int(rng.integers(0, 5000))}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, fp int, node int").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs, bucket_rows=bucket_rows).collect()}
    assert sorted(got) == list(range(len(texts)))
    sets = shingle_sets(texts)
    similar = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    for i in range(len(texts)):
        for j in range(i):
            if similar(i, j) >= 0.85:
                assert got[i] == got[j]
            elif got[i] == got[j]:
                assert similar(i, j) > 0
    odd = spark.createDataFrame([(3, None), (None, ""), (5, " "), (7, "a b"), (7, "A b"), (None, "c d e f g h")], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(odd).collect()), key=str)
    assert found == sorted([(3, 3), (None, 3), (5, 3), (7, 7), (7, 7), (None, None)], key=str)
    assert S.near_duplicates(odd.limit(0)).count() == 0


def test_fingerprint_words_and_bits():
    texts = ["", "a b c d e f g", "x " * 3000]
    one, many = S.fingerprints(texts, 3, 1), S.fingerprints(texts, 3, 8)
    assert (one[:, 0] == many[:, 0]).all()
    assert [int(x) for x in one[:, 0]] == [simhash_brute(t) for t in texts]
    assert len({tuple(row) for row in many.tolist()}) == 3
    assert len(set(many[1].tolist())) == 8
    assert (S.differing_bits(1.0, 512), S.differing_bits(0.8, 512)) == (0, 77)
