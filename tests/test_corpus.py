"""The corpus source, ignore rules and the index on small trees."""

import hashlib
import json
import os
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.functions.paths import compile_ignore, extensions_of, is_ignored, normalise_extensions
from textmill.functions.providers import HashingEmbedder
from textmill.operators import index
from textmill.operators.index import Collection, embed_entries, index_files, index_repo, preview_index, store_note, sync_files, sync_repo, upsert_files
from textmill.operators.vectors import top_k
from textmill.operators.manifest import parse_manifest, render_manifest
from textmill.sources import collection as sink
from textmill.sources import corpus
from textmill.sources.collection import write_collection
from textmill.sources.corpus import build_entries, chunk_rows, deal, decode_ignoring, read_corpus
from textmill.streaming.streams import sync_stream, sync_tree


def tree(root, files):
    for name, content in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


FILES = {
    "pkg/__init__.py": "", "pkg/.hidden.py": "x = 1\n", "pkg/UPPER.PY": "y = 2\r\nz = 3\r\n", "build/x.py": "no", "a.tar.gz": "no", "docs/guide.md": "pre\n# One\na\n# Two\nb\n",
    "bad.txt": b"\xffok\xfe", "skip/me.py": "no", "skip/not.md": "# k\n# l\n", "data.json": "{}", ".gitignore": "skip/*\n!skip/not.md\n# note\n",
}


def test_read(spark, tmp_path):
    got = {r["rel_path"]: r for r in read_corpus(spark, tree(tmp_path, FILES)).collect()}
    assert sorted(got) == ["bad.txt", "data.json", "docs/guide.md", "pkg/.hidden.py", "pkg/UPPER.PY", "pkg/__init__.py", "skip/not.md"]
    assert bytes(got["bad.txt"]["content"]) == b"\xffok\xfe"
    assert got["pkg/UPPER.PY"]["suffix"] == ".py"


def test_below_an_excluded_name(spark, tmp_path):
    root = tree(tmp_path / "build", {"a.py": "x"})
    assert read_corpus(spark, root).count() == 1
    assert read_corpus(spark, root, strict_absolute="true").count() == 0


def test_missing_and_empty_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_corpus(spark, str(tmp_path / "none"))
    assert read_corpus(spark, str(tmp_path)).count() == 0


def test_single_file(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"x\xff\r\ny")
    got = read_corpus(spark, str(tmp_path / "a.log")).withColumn("text", decode_ignoring("content")).collect()
    assert [(r["rel_path"], r["suffix"], r["text"], r["error"]) for r in got] == [("a.log", ".log", "x\ny", None)]


def test_folders_are_shared_out(spark, tmp_path):
    files = {f"{a}/{b}/{c}.py": f"{a}{b}{c}" for a in "abc" for b in "xy" for c in "12"} | {"top.py": "t", "a/build/no.py": "no"}
    root = tree(tmp_path, files)
    for options, parts in (({}, 1), ({"files_per_partition": "1"}, 13), ({"bytes_per_partition": "6"}, 7), ({"listed_files": "1"}, 4), ({"listed_files": "8"}, 1)):
        df = read_corpus(spark, root, **options)
        assert sorted(r["rel_path"] for r in df.collect()) == sorted(k for k in files if "build" not in k)
        assert df.rdd.getNumPartitions() == parts


def test_deal():
    assert deal([("a", 5), ("b", 9), ("c", 1), ("d", 1)], 6, 9) == [["a"], ["b"], ["c", "d"]]
    assert deal([("a", 1), ("b", 1), ("c", 1)], 9, 2) == [["a", "b"], ["c"]]


def test_filters_are_pushed_down(spark, tmp_path):
    """Named paths are looked up, whether they belong to the corpus or not; nothing else is opened."""
    root = tree(tmp_path, FILES | {"docs/deep/a.py": "a", "docs/build/b.py": "b"})
    df = read_corpus(spark, root)
    asked = ["docs/guide.md", "skip/me.py", "skip/not.md", "docs/build/b.py", "no.py", "a.tar.gz", "docs", "../x.py"]
    got = df.where(F.col("rel_path").isin(asked))
    assert sorted(r["rel_path"] for r in got.collect()) == ["docs/guide.md", "skip/not.md"]
    assert "PushedFilters" not in got._jdf.queryExecution().toString() or "rel_path" in got._jdf.queryExecution().toString()
    assert sorted(r["rel_path"] for r in df.where(F.col("rel_path").startswith("docs/")).collect()) == ["docs/deep/a.py", "docs/guide.md"]
    assert df.where(F.col("rel_path").startswith("docs/build/")).count() == 0 and df.where("rel_path = 'pkg/UPPER.PY' AND suffix = '.py'").count() == 1
    reader = corpus._Reader({"path": root})
    assert list(reader.pushFilters([corpus.In(("rel_path",), tuple(asked)), corpus.EqualTo(("suffix",), ".md"), corpus.EqualTo(("rel_path",), "skip/not.md")])) == [corpus.EqualTo(("suffix",), ".md")]
    assert [p.files for p in reader.partitions()] == [["skip/not.md"]]


def test_a_sync_opens_what_changed(spark, tmp_path, monkeypatch):
    """Of six files with one changed, each is hashed once and the changed one is read once more."""
    root = tree(tmp_path / "src", {f"{k}.py": f"{k}\n" for k in range(6)})
    c = Collection(spark, str(tmp_path / "index"), "c")
    sync_repo(c, root)
    tree(tmp_path / "src", {"3.py": "new\n"})
    opened = spark.sparkContext.accumulator(0)
    asked = []
    real = corpus.read_corpus

    def counted(spark, root, **options):
        df = real(spark, root, **options)
        asked.append(options.get("digest"))
        kind = df.schema

        def run(batches):
            for batch in batches:
                opened.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, kind) if options.get("digest") else df

    monkeypatch.setattr("textmill.operators.index.read_corpus", counted)
    plans = []
    chunks = index._chunks
    monkeypatch.setattr("textmill.operators.index._chunks", lambda files, *rest: plans.append(files) or chunks(files, *rest))
    assert sync_repo(c, root) == "Synced c: 1 changed, 0 removed, 5 unchanged; 1 new chunk(s)."
    assert asked == [None, "true"] and opened.value == 6
    reader = corpus._Reader({"path": root})
    list(reader.pushFilters([corpus.EqualTo(("rel_path",), "3.py")]))
    assert [p.files for p in reader.partitions()] == [["3.py"]] and [r["rel_path"] for r in plans[0].collect()] == ["3.py"]


def test_digests_and_other_stores(spark, tmp_path):
    """A root with a scheme is listed by Hadoop, and holds the same."""
    root = tree(tmp_path, FILES)
    rows = lambda df: sorted((r["rel_path"], r["suffix"], hashlib.sha256(r["content"]).hexdigest()) for r in df.collect())
    local = rows(read_corpus(spark, root))
    seen = [r for r in local if r[0] != "pkg/.hidden.py"]
    assert rows(read_corpus(spark, f"file://{root}").where("error IS NULL")) == seen
    for at, want in ((root, local), (f"file://{root}", seen)):
        assert sorted((r["rel_path"], r["suffix"], r["sha256"]) for r in read_corpus(spark, at, digest="true").where("error IS NULL").collect()) == want
    assert [r["rel_path"] for r in read_corpus(spark, f"file://{root}").where("error IS NOT NULL").collect()] == ["pkg/.hidden.py"]
    assert [r["rel_path"] for r in read_corpus(spark, f"file://{root}/a.tar.gz").collect()] == ["a.tar.gz"]
    with pytest.raises(FileNotFoundError):
        read_corpus(spark, f"file://{root}/none")


def test_a_tree_as_a_stream(spark, tmp_path):
    """Files added, changed and deleted between runs, each of which begins anew from the checkpoint."""
    root = tree(tmp_path / "src", {"a.py": "1\n", "docs/b.md": "2\n", "build/no.py": "n"})
    c = Collection(spark, str(tmp_path / "index"), "c")

    def run():
        sync_tree(spark, root, c, str(tmp_path / "cp")).awaitTermination()
        return contents(c)

    assert run() == [("a.py", "1"), ("docs/b.md", "2")]
    assert run() == [("a.py", "1"), ("docs/b.md", "2")]
    tree(tmp_path / "src", {"a.py": "11\n", "c.py": "3\n"})
    os.remove(f"{root}/docs/b.md")
    assert run() == [("a.py", "11"), ("c.py", "3")]
    tree(tmp_path / "src", {"docs/b.md": "2\n"})
    assert run() == [("a.py", "11"), ("c.py", "3"), ("docs/b.md", "2")]
    os.remove(f"{root}/a.py")
    os.remove(f"{root}/c.py")
    os.remove(f"{root}/docs/b.md")
    assert run() == []
    assert len(os.listdir(tmp_path / "cp" / "listings")) <= 2


def test_levels():
    same = lambda levels: index._same_level([{"level": n} for n in levels], 4)
    assert same([0, 0, 0]) is None and same([0, 0, 0, 0]) == (0, 4) and same([2, 1, 0, 0, 0, 0]) == (2, 6)
    assert same([0, 0, 0, 1]) == (0, 4)  # small ones before a larger one count as large


def test_rewritten_bytes_grow_with_the_logarithm(spark, tmp_path, monkeypatch):
    """Of 100 changes of one row each, a row is written again at most once a level."""
    c = Collection(spark, str(tmp_path), "c")
    rewritten = []
    monkeypatch.setattr(Collection, "_entries", lambda self, segments: rewritten.append(sum(s["rows"] for s in segments)))
    monkeypatch.setattr(Collection, "_manifest", lambda self, segments: None)
    monkeypatch.setattr(Collection, "_part", lambda self, segments, part: None)
    monkeypatch.setattr(Collection, "_segment", lambda self, e, m, g, level=0: {"name": f"s{len(names)}-{names.append(1)}", "parts": [], "level": level, "rows": rewritten[-1] if level else 1})
    names, states = [], [{"segments": []}]
    monkeypatch.setattr(Collection, "_state", lambda self: states[-1])
    monkeypatch.setattr(Collection, "_commit", lambda self, change: states.append(change(states[-1])))
    for _ in range(100):
        states.append({"segments": [*states[-1]["segments"], c._segment(None, None, None)]})
        c.compact()
    assert sum(rewritten) <= 100 * 4 and len(states[-1]["segments"]) <= 12 and sum(s["rows"] for s in states[-1]["segments"]) == 100


def test_a_lost_race_is_done_again(spark, tmp_path, monkeypatch):
    """A writer whose number was taken, as its claim was stale, commits after the other."""
    c = Collection(spark, str(tmp_path), "c")
    index_files(c, files(spark, [("a.py", "a")]))
    real, turns = c._renamed, []

    def late(made, to):
        if not turns:
            turns.append(1)
            state = c._read(0)
            (tmp_path / "c" / "log" / "0000000001.json").write_text(json.dumps(state | {"batches": {"other": 7}}))
        return real(made, to)

    monkeypatch.setattr(c, "_renamed", late)
    store_note(c, "n", {})
    assert contents(c) == [("", "n"), ("a.py", "a")] and c.last_batch("other") == 7 and c._numbers() == [0, 1, 2]


def test_a_segment_that_fails_leaves_nothing(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "c")
    index_files(c, files(spark, [("a.py", "a")]))
    before = sorted(os.listdir(tmp_path / "c"))
    with pytest.raises(Exception, match="broken"):
        c.add(c.entries().withColumn("content", F.raise_error(F.lit("broken"))))
    assert sorted(os.listdir(tmp_path / "c")) == before and contents(c) == [("a.py", "a")]


def test_entries(spark, tmp_path):
    rows = build_entries(spark, tree(tmp_path, FILES), size=1, overlap=0).orderBy("metadata.file_path", "chunk_no").collect()
    assert [(r["metadata"]["file_path"], r["metadata"]["line_range"], r["metadata"]["type"], r["content"]) for r in rows] == [
        ("bad.txt", "1-1", "doc", "ok"), ("data.json", "1-1", "code", "{}"), ("docs/guide.md", "2-3", "doc", "# One\na"), ("docs/guide.md", "4-5", "doc", "# Two\nb"),
        ("pkg/.hidden.py", "1-1", "code", "x = 1"), ("pkg/UPPER.PY", "1-1", "code", "y = 2"), ("pkg/UPPER.PY", "2-2", "code", "z = 3"), ("skip/not.md", "1-1", "doc", "# k"), ("skip/not.md", "2-2", "doc", "# l"),
    ]


@pytest.mark.parametrize(
    ("rules", "path", "hit"),
    [
        (["*.log"], "a/b.log", True), (["*.log"], "a/b.log/c", True), (["/a"], "a/x", True), (["/a"], "b/a", False), (["a/"], "a", False), (["a/"], "b/a/c", True), (["a/b"], "x/a/b", False),
        (["**/b"], "x/a/b", True), (["a/**"], "a/x/y", True), (["a/**"], "a", False), (["a/**/b"], "a/b", True), (["a/**/b"], "a/x/y/b", True), (["?.c"], "a.c", True), (["?.c"], "ab.c", False),
        (["[ab].c"], "b.c", True), (["[!ab].c"], "b.c", False), (["*.c", "!x.c"], "x.c", False), (["!x.c", "*.c"], "x.c", True), (["\\#a"], "#a", True), (["# a", ""], "# a", False), (["a*b"], "axx/b", False),
    ],
)
def test_ignore_rules(rules, path, hit):
    assert is_ignored(path, compile_ignore(rules)) is hit


def test_extensions():
    assert normalise_extensions(["PY", ".md", "py"]) == [".py", ".md"]
    assert len(extensions_of("code")), len(extensions_of("docs")) == (23, 4)
    with pytest.raises(ValueError, match="unknown scope"):
        extensions_of("all")


def contents(collection):
    return sorted((r["metadata"]["file_path"] or "", r["content"]) for r in collection.entries().collect())


def test_sync_equals_rebuild(spark, tmp_path):
    root = tree(tmp_path / "src", {"a.py": "one\n", "b.md": "# x\n# y\n", "c.py": "three\n"})
    c = Collection(spark, str(tmp_path / "index"), "c")
    assert sync_repo(c, root).startswith("Synced c: 3 changed, 0 removed, 0 unchanged")
    assert sync_repo(c, root).startswith("No changes: 3")
    store_note(c, "by hand", {"file_path": "a.py"})
    tree(tmp_path / "src", {"a.py": "changed\n", "d.py": "new\n"})
    os.remove(f"{root}/c.py")
    assert sync_repo(c, root) == "Synced c: 2 changed, 1 removed, 1 unchanged; 2 new chunk(s)."
    fresh = Collection(spark, str(tmp_path / "index"), "d")
    index_repo(fresh, root, reset=True)
    assert contents(c) == sorted([*contents(fresh), ("a.py", "by hand")])
    assert sync_repo(c, root, chunk_lines=5).startswith("Synced c: 3 changed")
    assert ("a.py", "by hand") in contents(c)


def test_index_again_doubles_rows(spark, tmp_path):
    root = tree(tmp_path / "src", {"a.py": "one\n"})
    c = Collection(spark, str(tmp_path / "index"), "c")
    assert c.info().first()["status"] == "missing"
    assert index_repo(c, root) == "Indexed 1 chunk(s) into c: 1 code, 0 doc."
    index_repo(c, root)
    assert c.info().first()["points"] == 2
    index_repo(c, root, reset=True)
    assert c.info().first()["points"] == 1
    with pytest.raises(ValueError, match="holds vectors"):
        sync_repo(c, root, embedder=HashingEmbedder(8))
    n, first = preview_index(spark, root, limit=1)
    assert (n, first.first()["preview"]) == (1, "one...")


def test_collection_needs_a_name(spark, monkeypatch, tmp_path):
    monkeypatch.delenv("COLLECTION_NAME", raising=False)
    with pytest.raises(ValueError, match="required"):
        Collection(spark, str(tmp_path), None)


def test_search_finds_the_words(spark):
    rows = spark.createDataFrame([(1, "red green blue"), (2, "one two"), (3, "red one")], "id int, t string")
    e = HashingEmbedder(256)
    vectors = rows.select("id", e.embed(F.col("t")).alias("vec"))
    query = spark.createDataFrame([(9, "two one")], "query_id int, t string").select("query_id", e.embed(F.col("t")).alias("query_vec"))
    got = top_k(vectors, query, k=2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 3]
    assert got[0]["score"] == pytest.approx(1, abs=1e-6)


def files(spark, rows, schema="rel_path string, content string"):
    return spark.createDataFrame(rows, schema)


def test_segments_are_compacted_and_cleaned(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "c")
    now = {f"{k}.py": f"line {k}\n" for k in range(4)}
    for turn in range(10):
        now[f"{turn % 5}.py"] = f"turn {turn}\n"
        now.pop(f"{(turn + 2) % 5}.py", None)
        sync_files(c, files(spark, list(now.items())))
        if turn == 4:
            store_note(c, "note", {"file_path": "1.py"})
        fresh = Collection(spark, str(tmp_path), "d")
        index_files(fresh, files(spark, list(now.items())), reset=True)
        assert contents(c) == sorted([*contents(fresh), *([("1.py", "note")] if turn > 3 else [])])
        assert sorted(map(tuple, c.manifest().collect())) == sorted(map(tuple, fresh.manifest().collect()))
    state = c._state()
    assert len(state["segments"]) < 8
    on_disk = {x for x in os.listdir(tmp_path / "c") if x.startswith("segment-")}
    assert {s["name"] for s in state["segments"]} < on_disk  # what earlier states list is still there
    late = Collection(spark, str(tmp_path), "c", retained=0)
    before = contents(late)
    store_note(late, "last", {})
    time.sleep(0.01)
    late._clean()
    state = late._state()
    assert {x for x in os.listdir(tmp_path / "c") if x.startswith("segment-")} == {s["name"] for s in state["segments"]}
    assert len([x for x in os.listdir(tmp_path / "c" / "log") if x.endswith(".json")]) == 1
    assert contents(late) == sorted([*before, ("", "last")])


def test_writers_at_once_keep_both(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "c")
    index_files(c, files(spark, [("a.py", "a")]))
    segment = c._segment(c.entries(), None, None)
    store_note(c, "meanwhile", {})  # another writer commits between the segment and its commit
    c._commit(lambda state: state | {"segments": [*state["segments"], segment]})
    assert contents(c) == [("", "meanwhile"), ("a.py", "a"), ("a.py", "a")]


def test_claim_of_a_lost_writer_runs_out(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "c")
    index_files(c, files(spark, [("a.py", "a")]))
    claim = tmp_path / "c" / "log" / "0000000001.claim"
    claim.write_text("")
    os.utime(claim, (0, 0))
    store_note(c, "n", {})
    assert c.info().first()["points"] == 2


def test_upsert_and_stream(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "index"), "c")
    assert upsert_files(c, files(spark, [("a.py", "1"), ("b.py", "2")])) == 2
    assert upsert_files(c, files(spark, [("a.py", "1"), ("b.py", None), ("x.py", None)])) == 1
    assert contents(c) == [("a.py", "1")]
    assert upsert_files(c, files(spark, [("a.py", "old", 1), ("a.py", "new", 2)], "rel_path string, content string, seq int"), stream=("s", 0)) == 1
    assert upsert_files(c, files(spark, [("a.py", "again")]), stream=("s", 0)) == 0
    assert contents(c) == [("a.py", "new")]
    source = tmp_path / "in"
    for k, rows in enumerate(([("a.py", "s1"), ("c.py", "s2")], [("a.py", None)], [("c.py", "s2"), ("d.py", "s3")])):
        files(spark, rows).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("rel_path string, content string").json(str(source))
        sync_stream(stream, c, str(tmp_path / "cp")).awaitTermination()
        assert contents(c) == [[("a.py", "s1"), ("c.py", "s2")], [("c.py", "s2")], [("c.py", "s2"), ("d.py", "s3")]][k]


def test_manifest_of_what_was_cut(spark, tmp_path):
    """A file that changes between hashing and cutting is cut again by the next sync."""
    root = tree(tmp_path / "src", {"a.py": "one\n"})
    c = Collection(spark, str(tmp_path / "index"), "c")
    sync_repo(c, root)
    for text in ("two\n", "three\n"):
        tree(tmp_path / "src", {"a.py": text})
        sync_repo(c, root)
        assert contents(c) == [("a.py", text.strip())]
    pairs = [("a", "1"), ("b", None), ('q"', "2")]
    made = render_manifest(spark.createDataFrame(pairs, "rel_path string, sha256 string"))
    assert [r["rel_path"] for r in made.collect()] == ["a", "b", 'q"']
    assert sorted(map(tuple, parse_manifest(made).collect()), key=str) == sorted(pairs, key=str)


def test_top_k_edge_cases(spark):
    vectors = spark.createDataFrame([(5, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (2, [0.0, 1.0]), (1, None), (9, [-1.0, 0.0])], "id int, vec array<double>")
    queries = spark.createDataFrame([("q", [3.0, 0.0]), ("zero", [0.0, 0.0]), ("none", None)], "query_id string, query_vec array<double>")
    got = [tuple(r) for r in top_k(vectors, queries, k=4).orderBy("query_id", "rank").collect()]
    assert got == [("q", 3, 1.0, 1), ("q", 4, 1.0, 2), ("q", 2, 0.0, 3), ("q", 5, 0.0, 4), *(("zero", i, 0.0, k + 1) for k, i in enumerate((2, 3, 4, 5)))]
    assert [r["id"] for r in top_k(vectors, queries, k=1, metric="dot").orderBy("query_id").collect()] == [4, 2]
    assert top_k(vectors.limit(0), queries).count() == 0
    assert top_k(vectors, queries.limit(0)).count() == 0


def test_the_sink_commits_all_or_nothing(spark, tmp_path):
    rows = chunk_rows(spark.createDataFrame([(f"{k}.py", f"line {k}") for k in range(8)], "p string, t string").repartition(4), "p", "t")
    entries = embed_entries(rows, HashingEmbedder(8))
    new = {"embedding_model": "hashing-8", "dimensions": "8"}
    with pytest.raises(Exception, match="needs embedding_model"):
        write_collection(spark, entries, str(tmp_path), "c")
    write_collection(spark, entries, str(tmp_path), "c", **new)
    c = Collection(spark, str(tmp_path), "c")
    assert len(contents(c)) == 8 and c.settings() == index.IndexSettings("hashing-8", 8)
    store_note(c, "note", {}, HashingEmbedder(8))
    write_collection(spark, entries.limit(2), str(tmp_path), "c")
    assert len(contents(c)) == 11
    before = sorted(x for x in os.listdir(tmp_path / "c") if x.startswith("segment-"))
    broken = entries.withColumn("content", F.when(F.col("metadata.file_path") == "5.py", F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        write_collection(spark, broken, str(tmp_path), "c")
    assert sorted(x for x in os.listdir(tmp_path / "c") if x.startswith("segment-")) == before and len(contents(c)) == 11
    write_collection(spark, entries.limit(0), str(tmp_path), "c")
    assert len(contents(c)) == 11
    write_collection(spark, entries.limit(3), str(tmp_path), "c", mode="overwrite", **new)
    assert len(contents(c)) == 3


def test_the_sink_drops_what_an_attempt_left(spark, tmp_path):
    """A file of an attempt that doesn't count goes, and a number that another writer took isn't overwritten."""
    schema = embed_entries(chunk_rows(spark.createDataFrame([("a.py", "x")], "p string, t string"), "p", "t"), HashingEmbedder(8)).schema
    writer = sink._Writer({"path": str(tmp_path), "name": "c", "embedding_model": "m", "dimensions": "8"}, schema, False)
    batch = pa.RecordBatch.from_pydict({"content": ["a", "b"]})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    other = sink._Writer({"path": str(tmp_path), "name": "c", "embedding_model": "m", "dimensions": "8"}, schema, False)
    other.commit([other.write(iter([batch]))])
    writer.commit([kept, sink.Written(None, 0)])
    assert os.listdir(writer._entries) == [kept.name] and lost.name != kept.name
    assert writer._numbers() == [0, 1] and [s["name"] for s in json.loads((tmp_path / "c" / "log" / "0000000001.json").read_text())["segments"]] == [other.segment, writer.segment]


def test_decoding_and_vectors_of_a_batch_make_no_python_objects(spark):
    """Peak memory of the two Python steps is near that of their batch, and the results are those of Python's own."""
    raw = [None, b"", b"a\r\nb\rc", "é\ufffd\x01".encode(), b"\xff" + "ü\r".encode() + b"\xe2\x82", b"\xed\xa0\x80x"]
    want = [None if c is None else c.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for c in raw]
    assert decode_ignoring.func(pa.array(raw, pa.binary())).to_pylist() == want
    assert decode_ignoring.func(pa.array(raw[:4], pa.binary())).to_pylist() == want[:4]
    texts = [(0, "a b c " * 30_000), (1, None), (2, ""), (3, "x y"), (4, "z " * 70_000)]  # over a run of words at once
    got = spark.createDataFrame(texts, "k int, t string").coalesce(1).select("k", HashingEmbedder(8).embed(F.col("t")).alias("v"))
    vectors = {r["k"]: r["v"] for r in got.collect()}
    place = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(8))).first()[0] for w in "abcxyz"}
    for k, text in texts:
        counts = [0.0] * 8
        for w in (text or "").split():
            counts[place[w]] += 1
        norm = max(sum(c * c for c in counts) ** 0.5, 1)
        assert vectors[k] == pytest.approx([c / norm for c in counts], abs=1e-6)
    batch = pa.array([b"word " * 400] * 2000, pa.binary())
    tracemalloc.start()
    decode_ignoring.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < batch.nbytes / 10
