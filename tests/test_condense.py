"""Condensing, events, evaluation and streams."""

import json
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.functions.providers import BatchCompleter, BatchEmbedder, BatchFetcher, BatchRunner, ExtractiveCompleter, describe_models, is_reachable, resolve_model
from textmill.functions.settings import number_setting
from textmill.operators import compress as C
from textmill.operators import evaluate, events
from textmill.operators.asked import StoredEmbedder
from textmill.operators.index import embed_entries
from textmill.streaming.fetches import gate_fetches
from textmill.streaming.streams import route_events

LONG = "w" * 81


def run(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = C.compress(df, "i", "t", **options)
    return [(r["result"], r["shown"]) for r in sorted(got.select("i", "result", C.render(F.col("result")).alias("shown")).collect())]


def test_gates(spark):
    limits = C.Limits(skip_if_under_chars=10, chunk_chars=5, max_total_chars=20)
    got = run(spark, ["x" * 9, "x" * 10, "x" * 20, "x" * 21, None], limits=limits)
    assert [r["status"] for r, _ in got] == ["unchanged", "compressed", "compressed", "error", "unchanged"]
    assert got[0][1] == "x" * 9
    assert got[3][1].startswith("Error: the text has 21 characters")
    assert got[1][1] == "[compressed 10 -> 34 chars across 2 chunk(s), ~-240% smaller]\n\n[part 1/2]\nxxxxx\n\n[part 2/2]\nxxxxx"


def test_positional_scope(spark):
    text = "x" * 400 + "\n" + LONG + "\nHead\n" + LONG + "y" * 5000
    plain = "z" * 9000
    limits = C.Limits(skip_if_under_chars=10)
    got = [r for r, _ in run(spark, [text, plain], focus="the introduction", limits=limits)]
    assert [(r["original_len"], r["auto_truncated"]) for r in got] == [(483, True), (4000, True)]
    assert run(spark, [text], focus="the introduction")[0][0]["status"] == "unchanged"
    assert [r["original_len"] for r, _ in run(spark, [plain], max_chars=-8000, limits=limits)] == [1000]
    assert run(spark, [plain], max_chars=0, limits=limits)[0][0]["body"] == ""


def test_nothing_relevant(spark):
    limits = C.Limits(skip_if_under_chars=1, chunk_chars=4)
    shown = run(spark, ["abcdefghij"], focus="it's", completer=ExtractiveCompleter("q"), limits=limits)[0][1]
    assert shown == 'Error: none of the 3 chunk(s) held anything on "it\'s".'


def service(answers):
    def make():
        def complete(prompts):
            return [answers(p) for p in prompts]

        return complete

    return BatchCompleter(make)


def test_failures_and_markers(spark):
    limits = C.Limits(skip_if_under_chars=1, chunk_chars=4)

    def answers(prompt):
        text = prompt.rpartition("\n\n")[2]
        if prompt.startswith("Answer"):
            return None if "F" in text else "maybe"
        if prompt.startswith("Write"):
            return None if "X" in text else "[not relevant]" if "m" in text else text.upper()
        return "all: " + str(prompt.count("[part"))

    got = [r for r, _ in run(spark, ["aaaammmm", "aaaabbbbmmmm", "aaaaFbbbXccc", "aaaabbbbXccc"], completer=service(answers), limits=limits)]
    assert [(r["status"], r["n_skipped"], r["body"]) for r in got[:2]] == [("compressed", 1, "AAAA"), ("compressed", 1, "all: 2")]
    assert got[2]["error"] == "Error: the relevance request failed on chunk 2 of 3."
    assert got[3]["error"] == "Error: the extraction request failed on chunk 3 of 3."


def test_ratio_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(0, 5), (8, 7), (8, 5), (100, 105)], "o int, c int")
    assert [r[0] for r in df.select(C.ratio(F.col("o"), F.col("c"))).collect()] == [0, 12, 38, -5]


def test_repr(spark):
    texts = ["a", "it's", "a\"'b", "x\\y\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r[1] for r in sorted(df.select("i", C.python_repr(F.col("t"))).collect())] == [repr(t) for t in texts]


def test_models():
    assert resolve_model("a", "b", ["c"]) == ("a", None)
    assert resolve_model(None, "b", None) == ("b", None)
    assert resolve_model(None, None, ["c"]) == ("c", None)
    errors = [resolve_model(None, None, x)[1] for x in (None, [], ["c", "d"])]
    assert len(set(errors)) == 3
    assert all(e.startswith("Error:") for e in errors)
    assert describe_models(["a", "b"]) == "a, b"


def test_leaves_and_write_back(spark):
    value = {"a": "x" * 300, "b": [1, "y" * 250, {"c": "small"}], "k": None}
    df = spark.createDataFrame([(1, json.dumps(value)), (2, "not json"), (3, None), (4, '"top"')], "k int, j string")
    got = [tuple(r) for r in events.json_leaves(df, "k", "j").orderBy("k", "ordinal").collect()]
    assert [(k, p, o) for k, p, o, _ in got] == [(1, ["a"], 0), (1, ["b", "1"], 1), (1, ["b", "2", "c"], 2), (4, [], 0)]
    new = [json.loads(r[0]) if r[0] and r[0][0] in '{"' else r[0] for r in df.orderBy("k").select(events.write_back(F.col("j"), F.lit("R"))).collect()]
    assert new == [{"a": "R", "b": [1, "", {"c": "small"}], "k": None}, "not json", None, "R"]
    assert events.rewrite(json.dumps(["z" * 200, "y" * 200]), "R", 200) == '["R", ""]'


def test_small_leaves_are_left(spark):
    df = spark.createDataFrame([(1, k, "x" * 199) for k in range(50)] + [(2, 0, "x" * 1000), (2, 1, "y" * 1000)], "k int, o int, t string")
    got = events.select_leaves(df, "k", leaf="t", ordinal="o").collect()
    assert [(r["k"], r["largest"], r["total_chars"]) for r in got] == [(2, 0, 2000)]


def test_evaluation(spark):
    runs = [("A", "t", "baseline", 100.0, True), ("A", "t", "treatment", 60.0, True), ("A", "u", "baseline", 10.0, True), ("A", "u", "treatment", 5.0, False), ("A", "v", "baseline", 1.0, True)]
    pairs = evaluate.paired(spark.createDataFrame(runs, "track string, task string, condition string, tokens double, correct boolean"))
    assert {r["task"]: (r["reduction"], r["wins"]) for r in pairs.collect()} == {"t": (0.4, True), "u": (0.5, False)}
    got = evaluate.net(pairs, spark.createDataFrame([("A", 7), ("A", 3)], "track string, tokens long")).first()
    assert (got["saved"], got["overhead"], got["net"]) == (45.0, 10, 35.0)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [{"tool_name": "WebFetch", "tool_input": json.dumps({"url": "u"}), "tool_response": "r"}, {"tool_name": "Bash", "tool_input": json.dumps({"command": "ls"})}]
    (src / "a.txt").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    raw = spark.readStream.format("text").load(str(src))
    q = route_events(raw).writeStream.format("memory").queryName("routes").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp1")).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("routes").collect()) == [("Bash", "allow", "deny", False), ("WebFetch", "deny", "allow", True)]


def test_limits_need_a_character():
    with pytest.raises(ValueError, match="at least one"):
        C.Limits(chunk_chars=0)


def test_each_question_is_asked_once(spark, tmp_path):
    """N + R + 1 requests for a document of N chunks, R of them relevant; none for what is limited or short."""
    calls = str(tmp_path / "calls")

    def answers(prompt):
        with open(calls, "a") as f:
            f.write(prompt[0])
        text = prompt.rpartition("\n\n")[2]
        return ("YES" if "r" in text else "NO") if prompt.startswith("Answer") else text[:1]

    limits = C.Limits(skip_if_under_chars=8, chunk_chars=4)
    got = [r for r, _ in run(spark, ["rrrrnnnnrrrrnnnn", "nnnnrrrr", "short"], completer=service(answers), limits=limits)]
    assert [(r["status"], r["n_chunks"], r["n_skipped"]) for r in got] == [("compressed", 4, 2), ("compressed", 2, 1), ("unchanged", 0, 0)]
    with open(calls) as f:
        asked = f.read()
    assert (asked.count("A"), asked.count("W"), asked.count("M")) == (4 + 2, 2 + 1, 1)
    run(spark, ["rrrrnnnnrrrr"], max_chars=8, completer=service(answers), limits=limits)
    with open(calls) as f:
        assert f.read()[len(asked) :].count("A") == 0


def test_no_document_is_lost_by_a_model_of_moods(spark):
    import random

    def answers(prompt):
        return random.choice(["YES", "NO", "maybe", None, "[NOT RELEVANT]", "text"])

    texts = ["x" * (10 + k % 30) for k in range(200)]
    assert len(run(spark, texts, completer=service(answers), limits=C.Limits(skip_if_under_chars=1, chunk_chars=4))) == 200


def test_position_notes(spark):
    rows = spark.createDataFrame([(2, 3, False), (1, 1, True), (1, 1, False)], "at int, n int, cut boolean")
    notes = [r[0] for r in rows.select(C.position_note(F.col("at"), F.col("n"), F.col("cut"))).collect()]
    assert notes[0].startswith("This is part 2 of 3")
    assert "left out on purpose" in notes[1]
    assert notes[2] == "This is the whole text."


def test_equal_leaves_at_several_depths():
    large = "x" * 200
    for value, want in (
        ({"a": {"x": large}, "b": large}, {"a": {"x": "R"}, "b": ""}), ([[large], large], [["R"], ""]), ({"b": large, "a": [large, {"c": large + "y"}]}, {"b": "", "a": ["", {"c": "R"}]}),
    ):
        assert json.loads(events.rewrite(json.dumps(value), "R", 200)) == want


def test_bash_write_back(spark):
    rows = [('{"stdout":"a","n":1,"deep":{"k":[1,null,"\\u00e9"]},"stderr":"e"}', "R"), ("{}", "R"), ("[1]", "R"), ("broken", "R"), (None, "R"), ('{"a":1}', None)]
    df = spark.createDataFrame(rows, "j string, r string")
    got = [r[0] for r in df.select(events.bash_write_back(F.col("j"), F.col("r"))).collect()]
    assert json.loads(got[0]) == {"stdout": "R", "n": 1, "deep": {"k": [1, None, "é"]}, "stderr": ""}
    assert json.loads(got[1]) == {"stdout": "R", "stderr": ""}
    assert got[2:] == ["[1]", "broken", None, '{"a":1}']


def test_fetchers_and_runners(spark):
    def get(url):
        if "bad" in url:
            raise OSError("refused")
        return f"<b>{url}</b>" if "empty" not in url else "<b></b>"

    urls = spark.createDataFrame([("u",), ("u",), ("bad",), ("empty",), (None,)], "a string")
    assert dict(map(tuple, C.compress_pages(urls, "a", BatchFetcher(lambda: get)).collect())) == {
        "u": "[fetched u, 8 raw bytes]\nu", "bad": "Error: bad wasn't fetched: refused", "empty": "Error: there is no text in empty.",
    }

    def call(command):
        if command == "slow":
            raise TimeoutError("timed out")
        return 1, command, "e"

    commands = spark.createDataFrame([("ls",), ("slow",), (None,)], "a string")
    assert dict(map(tuple, C.compress_commands(commands, "a", BatchRunner(lambda: call)).collect())) == {
        "ls": "[exit code 1]\nls\n--- stderr ---\ne", "slow": "Error: the command wasn't run: timed out",
    }


def test_reachability(spark):
    def broken():
        raise OSError

    assert [is_reachable(x) for x in (True, False, lambda: True, lambda: False, broken)] == [True, False, True, False, False]
    df = spark.createDataFrame([("WebFetch",)], "t string")
    assert [df.select(events.web_route(F.col("t"), F.lit("u"), F.lit("p"), probe)).first()[0] for probe in (lambda: True, broken)] == ["deny", "allow"]


def test_number_settings(monkeypatch):
    monkeypatch.delenv("SOME_NUMBER", raising=False)
    assert number_setting("SOME_NUMBER", 7) == 7
    for raw, want in (("", 7), (" 12 ", 12), ("-1", -1)):
        monkeypatch.setenv("SOME_NUMBER", raw)
        assert number_setting("SOME_NUMBER", 7) == want
    monkeypatch.setenv("SOME_NUMBER", "many")
    with pytest.raises(ValueError, match="SOME_NUMBER"):
        number_setting("SOME_NUMBER", 7)


def test_error_above_the_ceiling(spark):
    got = run(spark, ["x" * 2_000_001])[0]
    assert got[0]["status"] == "error"
    assert got[1] == "Error: the text has 2000001 characters and the limit is 2000000; nothing was left out, narrow the source."


def test_deep_and_odd_json(spark):
    deep, allowed_depth = "[" * 200_000 + '"x"' + "]" * 200_000, "[" * 500 + '"' + "y" * 300 + '"' + "]" * 500
    rows = [(1, deep), (2, allowed_depth), (3, '{"a": "\\ud800", "b": ["[[[", {"c": "z"}]}'), (4, "[" * 300_000), (5, None), (6, '"top"')]
    frame = spark.createDataFrame(rows, "id long, j string")
    got = sorted((r["id"], r["ordinal"], len(r["path"]), r["leaf"]) for r in events.json_leaves(frame, "id", "j").collect())
    assert got == [(2, 0, 500, "y" * 300), (3, 0, 1, "�"), (3, 1, 2, "[[["), (3, 2, 3, "z"), (6, 0, 0, "top")]
    back = {r["id"]: r["w"] for r in frame.select("id", events.write_back(F.col("j"), F.lit("R")).alias("w")).collect()}
    assert back[1] == deep and back[2] == "[" * 500 + '"R"' + "]" * 500 and back[4] == "[" * 300_000 and back[5] is None
    assert events.rewrite('{"a": "\\ud800", "b": "' + "x" * 200 + '"}', "R", 200) == '{"a": "\\ud800", "b": "R"}'


def counting(folder, answer, fail_once=None):
    """A completer that notes each prompt it gets as a file; ``fail_once`` raises for a text the first time."""

    def make():
        def complete(prompts):
            out = []
            for p in prompts:
                if fail_once and fail_once in p and not (folder / "failed").exists():
                    (folder / "failed").write_text("")
                    raise RuntimeError("lost")
                (folder / uuid.uuid4().hex).write_text(p)
                out.append(answer(p))
            return out

        return complete

    return BatchCompleter(make)


def asked_of(folder):
    return [p.read_text() for p in folder.iterdir() if p.name != "failed"]


def test_request_groups():
    assert C.request_groups([5, 5, 5, 5, 5], 10) == [0, 0, 1, 1, 2] and C.request_groups([50, 50, 1, 1, 1], 10) == [0, 0, 1, 1, 1] and C.request_groups([], 10) == []


def test_a_long_text_is_combined_in_rounds(spark, tmp_path):
    """2,000,000 characters whose 167 summaries don't fit one request: each request fits, and a
    second run asks nothing."""
    (tmp_path / "asked").mkdir()
    text = "".join(f"{k:07d}|" * 1500 for k in range(167))[:2_000_000]
    limits = C.Limits(combine_chars=3_000)
    body = lambda p: p.split("\n\n", 1)[1]
    done = lambda p: body(p)[:400] if p.startswith("Write") else "YES" if p.startswith("Answer") else "merged " + body(p)[:200]
    completer = counting(tmp_path / "asked", done)
    df = spark.createDataFrame([(1, text), (2, text), (3, "x" * 2_000)], "i int, t string")
    runs = []
    for _ in range(2):
        got = {r["i"]: r["result"] for r in C.compress(df, "i", "t", limits=limits, completer=completer, answers=C.Answers(str(tmp_path / "kept"))).collect()}
        runs.append(({i: r["body"] for i, r in got.items()}, len(asked_of(tmp_path / "asked"))))
        assert got[1]["status"] == "compressed" and got[1]["n_chunks"] == 167 and got[1]["body"].startswith("merged ") and got[1]["body"] == got[2]["body"]
    assert runs[0] == runs[1]
    prompts = asked_of(tmp_path / "asked")
    combining = [p for p in prompts if p.startswith("Merge")]
    assert len(combining) > 20 and max(len(body(p)) for p in combining) <= 3_000
    assert len(set(prompts)) == len(prompts)  # equal texts are asked about once


def test_a_lost_task_asks_only_its_own_again(spark, tmp_path):
    """A request that is lost with its task is asked again; answers that were written aren't."""
    (tmp_path / "asked").mkdir()
    limits = C.Limits(skip_if_under_chars=1, chunk_chars=4)
    completer = counting(tmp_path / "asked", lambda p: "YES" if p.startswith("Answer") else p[-4:], fail_once="Merge")
    df = spark.createDataFrame([(k, f"{k}aaa{k}bbb") for k in range(6)], "i int, t string")
    run = lambda: C.compress(df, "i", "t", limits=limits, completer=completer, answers=C.Answers(str(tmp_path / "kept"))).collect()
    with pytest.raises(Exception, match="lost"):
        run()
    first = asked_of(tmp_path / "asked")
    assert sum(p.startswith("Merge") for p in first) < 6
    assert {r["result"]["status"] for r in run()} == {"compressed"}
    again = asked_of(tmp_path / "asked")
    kinds = lambda prompts: {k: sum(p.startswith(k) for p in prompts) for k in ("Answer", "Write")}
    assert kinds(again) == kinds(first) == {"Answer": 12, "Write": 12}


def test_vectors_are_kept(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    folder = tmp_path / "asked"

    def make():
        def vectors(texts):
            for t in texts:
                (folder / uuid.uuid4().hex).write_text(t)
            return [[float(len(t)), 1.0] for t in texts]

        return vectors

    embedder = StoredEmbedder(BatchEmbedder("lengths", 2, make), str(tmp_path / "kept"))
    chunks = spark.createDataFrame([("a", 1), ("bb", 2), ("a", 3), (None, 4)], "content string, chunk_no int")
    for more in ([], [("ccc", 5)]):
        rows = chunks.unionByName(spark.createDataFrame(more, chunks.schema))
        got = sorted((r["chunk_no"], r["vec"]) for r in embed_entries(rows, embedder).collect())
        assert got == [(1, [1.0, 1.0]), (2, [2.0, 1.0]), (3, [1.0, 1.0]), (4, None), *([(5, [3.0, 1.0])] if more else [])]
    assert sorted(asked_of(folder)) == ["a", "bb", "ccc"]


def test_repr_of_what_is_not_printed(spark):
    texts = ["\x00\x7f​", "­ x　", "🙂\U000e0001", "it's\x1b", "é", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r[1] for r in sorted(df.select("i", C.python_repr(F.col("t"))).collect())] == [repr(t) for t in texts]


def test_main_content(spark):
    long = "A paragraph of the article that has words enough."
    page = f"<html><head><title>t</title></head><body><nav><p>{long}</p></nav><!-- <p>{long} --><script>{long}</script><div><a href=/>{long}</a></div><article><h1>Title</h1><p>{long}</p><P class=x>Read <a href=/b>more</a>: {long}</p></article><footer><div>{long}</div></footer></body>"
    df = spark.createDataFrame([(1, page), (2, "<p>short</p>"), (3, None), (4, ""), (5, "<p>" + long)], "i int, h string")
    got = {r["i"]: r["m"] for r in df.select("i", T.main_content("h").alias("m")).collect()}
    assert got == {1: f"{long}\nRead more : {long}", 2: "", 3: None, 4: "", 5: long}


def test_unreadable_events_are_counted(spark):
    raw = spark.createDataFrame([('{"tool_name": "Bash"}',), ("broken",), (None,), ("{}",)], "value string")
    seen = Observation("events")
    assert route_events(raw, observation=seen).count() == 1 and seen.get == {"read": 4, "unreadable": 3}


def test_fetches_that_failed_are_left_alone(spark, tmp_path):
    """Three runs over advancing time; state lasts from one to the next."""
    source, at = tmp_path / "in", "2026-01-01 10:{:02d}:{:02d}".format
    runs = [
        [("http://a/1", at(0, 0), None), ("http://a/1", at(0, 5), True), ("http://a/1", at(1, 0), None), ("http://a/2", at(1, 1), None), ("http://b/1", at(1, 2), None), (None, at(1, 2), None)],
        [("http://a/1", at(9, 59), None), ("http://a/3", at(9, 59), None), ("http://a/4", at(9, 59), None), ("http://a/5", at(9, 59), None), ("http://a/1", at(10, 6), None)],
        [("http://a/1", at(30, 0), True), ("http://a/1", at(30, 1), False), ("http://a/1", at(30, 2), None), ("no host", at(30, 3), None)],
    ]
    want = [
        [("http://a/1", "fetch"), ("http://a/1", "failed recently"), ("http://a/2", "fetch"), ("http://b/1", "fetch")],
        [("http://a/1", "failed recently"), ("http://a/3", "fetch"), ("http://a/4", "fetch"), ("http://a/5", "host is busy"), ("http://a/1", "host is busy")],
        [("http://a/1", "fetch"), ("no host", "fetch")],
    ]
    schema = "url string, at timestamp, failed boolean"
    for k, rows in enumerate(runs):
        spark.createDataFrame(rows, "url string, at string, failed boolean").coalesce(1).write.mode("append").json(str(source))
        gated = gate_fetches(spark.readStream.schema(schema).json(str(source)), requests=2)
        gated.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        got = [(r["url"], r["decision"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        assert sorted(got) == sorted(x for own in want[: k + 1] for x in own)
