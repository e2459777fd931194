"""The registered queries over the standard tables, each with the SQL that says the same.

The tables hold neither files nor headings, so some queries derive them: a document's path
is made of its source and id, a short line becomes a heading by a prefix or by losing its
closing punctuation, conversations are events whose turns are leaves.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import paths, text
from textmill.functions.providers import ExtractiveCompleter, RecordedRuns, StoredPages
from textmill.functions.storage import checkpoint_folder, remove
from textmill.operators import compress as condense
from textmill.operators import evaluate, events, index, manifest, vectors
from textmill.plans import service_queries
from textmill.sources.corpus import chunk_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Derived inputs: the same in a query and in its SQL.
def _lines_where_short(change) -> Column:
    lines = F.split("text", "\n", -1)
    return F.array_join(F.transform(lines, lambda x: F.when(F.char_length(x) < 60, change(x)).otherwise(x)), "\n")


def _boundary_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", _lines_where_short(lambda x: F.regexp_replace(x, r"[.!?:,)\]]+\z", "")).alias("text"))


_BOUNDARY = r"""
  b AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
    lambda x: CASE WHEN length(x) < 60 THEN regexp_replace(x, '[.!?:,)\]]+$', '') ELSE x END), chr(10)) AS text FROM documents)"""

_HEADING = r"""
  bl AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM b),
  bi AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM bl),
  bo AS (SELECT doc_id, l, i, sum(length(l[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l[i]) - 1 AS o FROM bi),
  hb AS (SELECT doc_id, min(o) AS boundary FROM bo WHERE o BETWEEN 300 AND 20000 AND length(trim(l[i])) BETWEEN 1 AND 59
    AND NOT regexp_matches(trim(l[i]), '[.!?:)\],]$') AND i > 1 AND i < len(l)
    AND length(trim(l[i - 1])) > 80 AND length(trim(l[i + 1])) > 80 GROUP BY doc_id)"""


def _markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", _lines_where_short(lambda x: F.concat(F.lit("# "), x)).alias("text"))


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hashed = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id")).alias("rel_path"), F.sha2("text", 256).alias("sha256"))
    now = hashed.where("doc_id % 10 <> 3").select("rel_path", "sha256")
    was = hashed.where("doc_id % 10 <> 4").select("rel_path", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("sha256")).alias("sha256"))
    return now, was


_CHANGES = """
  h AS (SELECT doc_id, 'doc/' || doc_id AS rel_path, sha256(text) AS sha256 FROM documents),
  now AS (SELECT rel_path, sha256 FROM h WHERE doc_id % 10 <> 3),
  was AS (SELECT rel_path, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha256 END AS sha256 FROM h WHERE doc_id % 10 <> 4),
  ch AS (SELECT coalesce(n.rel_path, w.rel_path) AS rel_path, CASE WHEN n.rel_path IS NULL THEN 'removed' WHEN w.rel_path IS NULL THEN 'added'
    WHEN n.sha256 = w.sha256 THEN 'unchanged' ELSE 'changed' END AS status FROM now n FULL OUTER JOIN was w ON n.rel_path = w.rel_path)"""

_WINDOWS = """
  w AS (SELECT doc_id, l, unnest(range(0, len(l), {step})) AS s FROM {lines}),
  win AS (SELECT doc_id, s + 1 AS start_line, least(s + {size}, len(l)) AS end_line, trim(array_to_string(l[s + 1 : s + {size}], chr(10)), chr(10) || ' ') AS content
    FROM w WHERE (s = 0 OR s - {step} + {size} < len(l)))"""


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.split_lines("text").alias("lines"))
    rows = docs.select("doc_id", F.explode(text.line_windows(F.col("lines"), 5, 1)).alias("w"))
    return rows.select("doc_id", F.concat_ws("-", "w.start_line", "w.end_line").alias("line_range"), "w.content")


CHUNK_LINES = "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')," + _WINDOWS.format(step=4, size=5, lines="d") + """
SELECT doc_id, start_line || '-' || end_line AS line_range, content FROM win WHERE content <> ''"""


def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _markdown_docs(spark, sf_dir).select("doc_id", text.split_lines("text").alias("lines"))
    rows = docs.select("doc_id", F.explode(text.heading_sections(F.col("lines"), 5, 1)).alias("w"))
    return rows.select("doc_id", "w.start_line", "w.end_line", F.sha2("w.content", 256).alias("content_sha256"))


CHUNK_MARKDOWN = """
WITH m AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) < 60 THEN '# ' || x ELSE x END) AS l FROM documents),
  n AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: starts_with(ltrim(l[i]), '#')) AS h FROM m),
  d AS (SELECT doc_id, l FROM n WHERE len(h) < 2),""" + _WINDOWS.format(step=4, size=5, lines="d") + """,
  k AS (SELECT doc_id, l, h, unnest(range(1, len(h) + 1)) AS k FROM n WHERE len(h) >= 2),
  sec AS (SELECT doc_id, h[k] AS start_line, coalesce(h[k + 1] - 1, len(l)) AS end_line, l FROM k),
  both_kinds AS (SELECT doc_id, start_line, end_line, content FROM win UNION ALL
    SELECT doc_id, start_line, end_line, trim(array_to_string(l[start_line : end_line], chr(10)), chr(10) || ' ') FROM sec)
SELECT doc_id, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, sha256(content) AS content_sha256 FROM both_kinds WHERE content <> ''"""


def char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.char_chunks("text", condense.CHUNK_CHARS).alias("c"))
    rows = docs.select("doc_id", F.size("c").alias("chunk_count"), F.posexplode("c").alias("at", "chunk"))
    return rows.select("doc_id", (F.col("at") + 1).alias("chunk_index"), "chunk_count", F.sha2("chunk", 256).alias("chunk_sha256"))


CHAR_CHUNKS = """
WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 12000)) AS s FROM documents)
SELECT doc_id, CAST(s / 12000 + 1 AS INT) AS chunk_index, CAST(ceil(greatest(length(text), 1) / 12000) AS INT) AS chunk_count,
  sha256(substring(text, s + 1, 12000)) AS chunk_sha256 FROM c"""


def heading_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _boundary_docs(spark, sf_dir).select("doc_id", text.heading_boundary("text").alias("boundary"))
    return found.where(F.col("boundary").isNotNull())


HEADING_BOUNDARY = f"WITH {_BOUNDARY},{_HEADING} SELECT doc_id, CAST(boundary AS INT) AS boundary FROM hb"

_FOCUS = ("Summarise the Introduction", "list every error", "the lede only", "TL;DR please", "abstract class names", "what was paid")


def compress_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _boundary_docs(spark, sf_dir)
    focus = F.element_at(F.array(*[F.lit(f) for f in _FOCUS]), (F.col("doc_id") % len(_FOCUS) + 1).cast("int"))
    limit = F.when(F.col("doc_id") % 11 == 0, F.lit(1500)).when(F.col("doc_id") % 13 == 0, F.lit(-100))
    scoped = docs.select("doc_id", "text", focus.alias("focus"), limit.alias("max_chars"))
    scoped = scoped.withColumn("scope", condense.scope_chars(F.col("text"), F.col("focus"), F.col("max_chars")))
    size = F.char_length(condense.truncate(F.col("text"), F.col("scope")))
    return scoped.select(
        "doc_id", text.looks_positional("focus").alias("is_positional"), F.coalesce("scope", F.lit(0)).alias("scope"), size.alias("scoped_len"),
        condense.gate(size, condense.Limits()).alias("status"),
    )


COMPRESS_GATES = f"""
WITH {_BOUNDARY},{_HEADING},
  f AS (SELECT b.doc_id, text, boundary, list_value({", ".join(repr(x) for x in _FOCUS)})[b.doc_id % {len(_FOCUS)} + 1] AS focus,
    CASE WHEN b.doc_id % 11 = 0 THEN 1500 WHEN b.doc_id % 13 = 0 THEN -100 END AS m FROM b LEFT JOIN hb ON b.doc_id = hb.doc_id),
  p AS (SELECT *, regexp_matches(lower(focus), '{"|".join(text.POSITIONAL_PHRASES)}') AS is_positional FROM f),
  s AS (SELECT *, coalesce(m, CASE WHEN is_positional THEN coalesce(boundary, 4000) END) AS scope FROM p),
  n AS (SELECT *, CASE WHEN scope IS NULL THEN length(text) WHEN scope < 0 THEN greatest(length(text) + scope, 0) ELSE least(length(text), scope) END AS scoped_len FROM s)
SELECT doc_id, is_positional, CAST(coalesce(scope, 0) AS INT) AS scope, CAST(scoped_len AS INT) AS scoped_len,
  CASE WHEN scoped_len < 2000 THEN 'unchanged' WHEN scoped_len > 2000000 THEN 'error' ELSE 'compress' END AS status FROM n"""


def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("o"), F.char_length(F.regexp_replace("text", "[aeiou ]", "")).alias("c"))
    return docs.select("doc_id", condense.ratio(F.col("o"), F.col("c")).alias("ratio"))


COMPRESSION_RATIO = """
WITH d AS (SELECT doc_id, length(text) AS o, length(regexp_replace(text, '[aeiou ]', '', 'g')) AS c FROM documents)
SELECT doc_id, CAST(CASE WHEN o = 0 THEN 0 ELSE round_even(100 * (1 - c / o), 0) END AS INT) AS ratio FROM d"""


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("rel_path", F.concat_ws("/", "source", "doc_id"))
    return manifest.file_hashes(docs, "rel_path", "text")


CONTENT_HASH = "SELECT source || '/' || doc_id AS rel_path, sha256(text) AS sha256 FROM documents"


def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.diff(*_manifests(spark, sf_dir))


SYNC_DIFF = f"WITH {_CHANGES} SELECT rel_path, status FROM ch"


def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.counts(manifest.diff(*_manifests(spark, sf_dir)))


SYNC_COUNTS = f"""WITH {_CHANGES} SELECT count(*) FILTER (status IN ('added', 'changed')) AS n_changed,
  count(*) FILTER (status = 'removed') AS n_removed, count(*) FILTER (status = 'unchanged') AS n_unchanged FROM ch"""


def sync_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = _manifests(spark, sf_dir)
    return manifest.kept_entries(was, manifest.diff(now, was), "rel_path")


SYNC_KEEP = f"WITH {_CHANGES} SELECT rel_path, sha256 FROM was WHERE rel_path NOT IN (SELECT rel_path FROM ch WHERE status <> 'unchanged')"


def sync_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = _manifests(spark, sf_dir)
    return manifest.files_to_chunk(now, manifest.diff(now, was))


SYNC_RECHUNK = f"WITH {_CHANGES} SELECT rel_path, sha256 FROM now WHERE rel_path IN (SELECT rel_path FROM ch WHERE status IN ('added', 'changed'))"


def manifest_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = _manifests(spark, sf_dir)
    return manifest.removed(manifest.diff(now, was))


MANIFEST_REMOVED = f"WITH {_CHANGES} SELECT rel_path FROM was EXCEPT SELECT rel_path FROM now"


def tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.strip_tags("html").alias("text"))


TAG_STRIP = r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages"""


def page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", condense.with_url(F.col("url"), F.octet_length("html"), condense.page_text(F.col("html"))).alias("text"))


PAGE_SOURCE = r"""SELECT page_id, '[fetched ' || url || ', ' || strlen(html) || ' raw bytes]' || chr(10) ||
  trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages"""


def hook_generic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    found = events.select_leaves(turns, "conv_id", leaf="text", ordinal="turn")
    return found.select("conv_id", "total_chars", "n_leaves", "largest", F.sha2("body", 256).alias("body_sha256"))


HOOK_GENERIC_SELECT = """
SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS total_chars, count(*) AS n_leaves,
  first(turn ORDER BY length(text) DESC, turn) AS largest, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS body_sha256
FROM conversations WHERE length(text) >= 200 GROUP BY conv_id HAVING sum(length(text)) >= 2000"""

_PAYLOAD = "'{\"kind\":\"' || event_type || '\",\"props\":' || props || ',\"who\":{\"user\":\"u' || user_id || '\",\"tags\":[\"' || event_type || '\",1,null]}}'"


def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", F.expr(_PAYLOAD).alias("payload"))
    leaves = events.json_leaves(rows, "event_id", "payload")
    return leaves.select("event_id", F.concat(F.lit("$"), F.array_join(F.transform("path", lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("."), p))), "")).alias("path"), "leaf")


JSON_LEAVES = f"""
WITH p AS (SELECT event_id, CAST({_PAYLOAD} AS JSON) AS j FROM events WHERE props IS NOT NULL)
SELECT event_id, replace(t.fullkey, '"', '') AS path, t.atom ->> '$' AS leaf FROM p, json_tree(p.j) t WHERE t.type = 'VARCHAR'"""

_TOOL = "CASE event_type WHEN 'view' THEN 'WebFetch' WHEN 'click' THEN 'Bash' WHEN 'purchase' THEN 'Grep' WHEN 'signup' THEN 'Edit' ELSE 'Glob' END"


def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr(_TOOL).alias("tool"), F.expr("CASE WHEN user_id % 3 = 0 THEN '' ELSE 'run ' || user_id END").alias("command"), "props")
    return rows.select(
        "event_id", events.allowed(F.col("tool"), F.col("props")).alias("condense"), events.web_route(F.col("tool"), F.lit("u"), F.lit("p"), True).alias("web"),
        events.command_route(F.col("command")).alias("command"),
    )


ROUTE_DECISION = f"""
WITH e AS (SELECT *, {_TOOL} AS tool FROM events)
SELECT event_id, tool IN ('Bash', 'Grep', 'WebFetch', 'Glob', 'WebSearch') AND props IS NOT NULL AS condense,
  CASE WHEN tool = 'WebFetch' THEN 'deny' ELSE 'allow' END AS web, CASE WHEN user_id % 3 = 0 THEN 'allow' ELSE 'deny' END AS command FROM e"""


def bash_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    response = F.to_json(F.struct(F.col("text").alias("stdout"), F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise("").alias("stderr"), F.lit(0).alias("exit")))
    rows = docs.select("doc_id", response.alias("r"))
    shown = condense.with_exit_code(F.lit(0), events.bash_text(F.col("r")))
    return rows.select("doc_id", events.bash_passes(F.col("r")).alias("passes"), F.sha2(shown, 256).alias("shown_sha256"))


BASH_GATE = """
WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 AND source <> '' THEN chr(10) || '--- stderr ---' || chr(10) || source ELSE '' END AS s FROM documents)
SELECT doc_id, length(s) >= 2000 AS passes, sha256('[exit code 0]' || chr(10) || s) AS shown_sha256 FROM t"""


def bash_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("stdout"), F.lit("warn").alias("stderr"), F.col("user_id").alias("pid"))).alias("r"))
    new = events.bash_write_back(F.col("r"), F.lit("short"))
    return rows.select("event_id", *[F.get_json_object(new, f"$.{k}").alias(k) for k in ("stdout", "stderr", "pid")])


BASH_WRITE_BACK = "SELECT event_id, 'short' AS stdout, '' AS stderr, CAST(user_id AS VARCHAR) AS pid FROM events"


def generic_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    whole = turns.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])).alias("r"))
    new = F.from_json(events.write_back(F.col("r"), F.lit("RESULT")), "array<string>")
    return whole.select("conv_id", F.posexplode(new).alias("place", "leaf")).select("conv_id", "place", F.sha2("leaf", 256).alias("leaf_sha256"))


GENERIC_WRITE_BACK = """
WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, turn, text,
  row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN length(text) >= 200 THEN length(text) ELSE 0 END DESC, turn) AS best FROM conversations)
SELECT conv_id, CAST(place AS INT) AS place, sha256(CASE WHEN length(text) < 200 THEN text WHEN best = 1 THEN 'RESULT' ELSE '' END) AS leaf_sha256 FROM r"""


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of two types."""
    path = F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".txt"))
    return _table(spark, sf_dir, "documents").select(path.alias("rel_path"), F.col("text").alias("content"))


def _document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(_document_files(spark, sf_dir), "rel_path", "content", size=5, overlap=1)


# No document has a line that begins with #, so files of both types are cut into windows.
_FILE_WINDOWS = """
  d AS (SELECT source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.txt' END AS doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''),""" + _WINDOWS.format(step=4, size=5, lines="d") + """,
  f AS (SELECT doc_id AS file_path, start_line, start_line || '-' || end_line AS line_range, CASE WHEN doc_id LIKE '%.py' THEN 'code' ELSE 'doc' END AS type, content FROM win WHERE content <> '')"""


def nested_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equally long leaves at several depths: the first in the order of the document is replaced."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.rpad(F.col("event_type"), 200, ".").alias("t"))
    payload = F.to_json(F.struct(F.struct(F.array(F.lit("small"), F.col("t")).alias("x")).alias("a"), F.col("t").alias("b"), F.struct(F.lit("kept").alias("y")).alias("c")))
    new = events.write_back(payload, F.lit("RESULT"))
    return rows.select("event_id", *[F.get_json_object(new, at).alias(name) for name, at in (("a0", "$.a.x[0]"), ("a1", "$.a.x[1]"), ("b", "$.b"), ("c", "$.c.y"))])


NESTED_WRITE_BACK = "SELECT event_id, 'small' AS a0, 'RESULT' AS a1, '' AS b, 'kept' AS c FROM events"


def page_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their addresses from a provider, condensed; those it doesn't have are errors."""
    stored = {"https://a.example/": "<p>Some <b>text</b></p>", "https://b.example/": "<p> </p>"}
    urls = _table(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, [*stored, "https://c.example/"])), (F.col("event_id") % 3 + 1).cast("int")).alias("url"))
    return condense.compress_pages(urls, "url", StoredPages(stored))


PAGE_FETCH = """SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'https://a.example/' WHEN 1 THEN 'https://b.example/' ELSE 'https://c.example/' END AS url,
  CASE event_id % 3 WHEN 0 THEN '[fetched https://a.example/, 23 raw bytes]' || chr(10) || 'Some text' WHEN 1 THEN 'Error: there is no text in https://b.example/.'
    ELSE 'Error: https://c.example/ wasn''t fetched: no page is stored for https://c.example/' END AS text FROM events"""


def command_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands run by a provider, their output condensed below the exit code."""
    runs = {"make": (2, "x" * 3000, "failed"), "ls": (0, "a b", "")}
    commands = _table(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, [*runs, "rm"])), (F.col("event_id") % 3 + 1).cast("int")).alias("command"))
    return condense.compress_commands(commands, "command", RecordedRuns(runs))


COMMAND_RUN = """SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'make' WHEN 1 THEN 'ls' ELSE 'rm' END AS command,
  CASE event_id % 3 WHEN 0 THEN '[exit code 2]' || chr(10) || '[compressed ' || length(repeat('x', 3000) || chr(10) || '--- stderr ---' || chr(10) || 'failed') || ' -> 80 chars across 1 chunk(s), ~97% smaller]' || chr(10) || chr(10) || repeat('x', 80)
    WHEN 1 THEN '[exit code 0]' || chr(10) || 'a b' ELSE 'Error: the command wasn''t run: no run is recorded of rm' END AS text FROM events"""


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.type_counts(_document_chunks(spark, sf_dir))


TYPE_COUNTS = f"WITH {_FILE_WINDOWS} SELECT type, count(*) AS n FROM f GROUP BY type"


def _new_collection(spark: SparkSession) -> index.Collection:
    """A collection for one query, deleted when Python ends."""
    root = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    atexit.register(remove, spark, root)
    return index.Collection(spark, root, "documents")


def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _new_collection(spark)
    index.index_files(made, _document_files(spark, sf_dir), chunk_lines=5, overlap=1)
    return made.info()


COLLECTION_INFO = f"WITH {_FILE_WINDOWS} SELECT 'documents' AS collection, 'ready' AS status, count(*) AS points FROM f"


def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of an older state of the files, brought up to date twice, has what a new one would."""
    files = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id"), F.lit(".py")).alias("rel_path"), F.col("text").alias("content"))
    was = files.where("doc_id % 10 <> 4").withColumn("content", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("content")))
    made = _new_collection(spark)
    index.index_files(made, was)
    index.sync_files(made, files.where("doc_id % 10 <> 3"))
    index.sync_files(made, files.where("doc_id % 10 <> 5"))
    return made.entries().select("metadata.file_path", "metadata.line_range", F.sha2("content", 256).alias("content_sha256"))


INDEX_SYNC = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '' AND doc_id % 10 <> 5),""" + _WINDOWS.format(step=40, size=50, lines="d") + """
SELECT 'doc/' || doc_id || '.py' AS file_path, start_line || '-' || end_line AS line_range, sha256(content) AS content_sha256 FROM win WHERE content <> ''"""


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.preview_entries(_document_chunks(spark, sf_dir))


PREVIEW = f"""WITH {_FILE_WINDOWS} SELECT file_path, line_range, type, replace(substring(content, 1, 200), chr(10), ' ') || '...' AS preview
FROM f ORDER BY file_path, f.start_line LIMIT 10"""


def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.preview_entries(_document_chunks(spark, sf_dir), one_line=False)


DRY_RUN = f"""WITH {_FILE_WINDOWS} SELECT file_path, line_range, type, substring(content, 1, 200) || '...' AS preview
FROM f ORDER BY file_path, f.start_line LIMIT 10"""


def file_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.regexp_replace("url", r"^https?://|[?#].*$", "")
    rows = _table(spark, sf_dir, "pages").select("page_id", at.alias("path"))
    named = rows.select("page_id", F.concat("path", F.element_at(F.array(*map(F.lit, (".py", ".MD", "/build/x.txt", ".lock"))), (F.col("page_id") % 4 + 1).cast("int"))).alias("path"))
    wanted = paths.extensions_of("both")
    return named.select("page_id", text.suffix("path").alias("suffix"), paths.has_extension("path", wanted).alias("wanted"), paths.in_excluded_folder("path", ["en"]).alias("excluded"), paths.entry_type("path").alias("type"))


_NAMES = "'" + "', '".join((*paths.EXCLUDED_FOLDERS, "en")) + "'"
FILE_FILTERS = rf"""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') || list_value('.py', '.MD', '/build/x.txt', '.lock')[page_id % 4 + 1] AS path FROM pages),
  s AS (SELECT *, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS suffix FROM p)
SELECT page_id, suffix, suffix IN ({", ".join(repr(x) for x in paths.extensions_of("both"))}) AS wanted, list_has_any(string_split(path, '/'), [{_NAMES}]) AS excluded,
  CASE WHEN suffix IN ('.md', '.mdx', '.rst', '.txt') THEN 'doc' ELSE 'code' END AS type FROM s"""

_IGNORE = ["*.html", "/www.*/", "!**/en/*5.html"]


def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.regexp_replace("url", r"^https?://|[?#].*$", "")
    return _table(spark, sf_dir, "pages").select("page_id", paths.ignored(at, paths.compile_ignore(_IGNORE)).alias("ignored"))


IGNORE_RULES = r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS a FROM pages)
SELECT page_id, CASE WHEN regexp_matches(a, '^(.*/)?en/[^/]*5\.html(/.*)?$') THEN false ELSE regexp_matches(a, '^www\.[^/]*/') OR regexp_matches(a, '\.html(/.*)?$') END AS ignored FROM p"""


def ext_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws(" , ", "event_type", F.lit(".PY"), F.lit(""), F.upper("event_type"))
    items = text.csv_set(raw)
    dotted = paths.normalised(items)
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(items, "|").alias("items"), F.array_join(dotted, "|").alias("extensions"))


EXT_NORMALISE = """SELECT event_id, event_type || '|.PY|' || upper(event_type) AS items, '.' || event_type || '|.py' AS extensions FROM events"""


def map_reduce_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    limits = condense.Limits(chunk_chars=1000)
    found = condense.compress(docs, "doc_id", "text", focus="what is said of that", limits=limits, completer=ExtractiveCompleter("tion"))
    return found.select("doc_id", "result.status", "result.n_chunks", "result.n_skipped", "result.ratio", F.sha2("result.body", 256).alias("body_sha256"), "result.error")


MAP_REDUCE = """
WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS s FROM documents WHERE length(text) >= 2000),
  k AS (SELECT doc_id, s, length(text) AS o, substring(text, s + 1, 1000) AS chunk FROM c),
  r AS (SELECT doc_id, s, o, contains(chunk, 'tion') AS yes, trim(substring(chunk, 1, 80), ' ' || chr(10)) AS summary FROM k),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY yes DESC, s) AS i, count(*) FILTER (yes) OVER (PARTITION BY doc_id) AS m FROM r),
  g AS (SELECT doc_id, any_value(o) AS o, any_value(m) AS m, count(*) AS n_chunks,
    string_agg(CASE WHEN m > 1 THEN '[part ' || i || '/' || m || ']' || chr(10) ELSE '' END || summary, chr(10) || chr(10) ORDER BY s) FILTER (yes) AS body FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN m = 0 THEN 'error' ELSE 'compressed' END AS status, CAST(n_chunks AS INT) AS n_chunks, CAST(n_chunks - m AS INT) AS n_skipped,
  CAST(CASE WHEN m = 0 THEN 0 ELSE round_even(100 * (1 - length(body) / o), 0) END AS INT) AS ratio, sha256(body) AS body_sha256,
  CASE WHEN m = 0 THEN 'Error: none of the ' || n_chunks || ' chunk(s) held anything on ''what is said of that''.' END AS error FROM g
UNION ALL SELECT doc_id, 'unchanged', 0, 0, 0, sha256(text), NULL FROM documents WHERE length(text) < 2000"""


def condense_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = condense.compress(docs, "doc_id", "text")
    return found.select("doc_id", F.sha2(condense.render(F.col("result")), 256).alias("rendered_sha256"))


CONDENSE_RENDERED = """
WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 12000)) AS s FROM documents WHERE length(text) BETWEEN 2000 AND 2000000),
  n AS (SELECT doc_id, s, length(text) AS o, trim(substring(text, s + 1, 80), ' ' || chr(10)) AS summary, count(*) OVER (PARTITION BY doc_id) AS m FROM c),
  g AS (SELECT doc_id, any_value(o) AS o, any_value(m) AS m,
    string_agg(CASE WHEN m > 1 THEN '[part ' || (s // 12000 + 1) || '/' || m || ']' || chr(10) ELSE '' END || summary, chr(10) || chr(10) ORDER BY s) AS body FROM n GROUP BY doc_id),
  a AS (SELECT doc_id, '[compressed ' || o || ' -> ' || length(body) || ' chars across ' || m || ' chunk(s), ~' ||
      CAST(round_even(100 * (1 - length(body) / o), 0) AS INT) || '% smaller]' || chr(10) || chr(10) || body AS t FROM g
    UNION ALL SELECT doc_id, CASE WHEN length(text) < 2000 THEN text ELSE 'Error: the text has ' || length(text) ||
      ' characters and the limit is 2000000; nothing was left out, narrow the source.' END FROM documents WHERE length(text) < 2000 OR length(text) > 2000000)
SELECT doc_id, sha256(t) AS rendered_sha256 FROM a"""

_ANSWERS = ("YES", " yes, it does", "No.", "NOT SURE", "", "it may", None, "[not relevant]", "This is NOT RELEVANT here")


def classifier_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(a).cast("string") for a in _ANSWERS]), (F.col("event_id") % len(_ANSWERS) + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select("event_id", pick.alias("a"))
    return rows.select("event_id", F.coalesce(condense.parse_answer(F.col("a")).cast("string"), F.lit("failed")).alias("relevant"), F.coalesce(condense.is_marker(F.col("a")), F.lit(False)).alias("marker"))


CLASSIFIER_ANSWERS = f"""
WITH a AS (SELECT event_id, list_value({", ".join("NULL" if x is None else repr(x) for x in _ANSWERS)})[event_id % {len(_ANSWERS)} + 1] AS a FROM events)
SELECT event_id, CASE WHEN a IS NULL THEN 'failed' WHEN upper(trim(a)) LIKE 'YES%' THEN 'true' WHEN upper(trim(a)) LIKE 'NO%' THEN 'false' ELSE 'true' END AS relevant,
  coalesce(upper(a) = '[NOT RELEVANT]' OR (length(a) < 34 AND contains(upper(a), 'NOT RELEVANT')), false) AS marker FROM a"""


def _evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.lit("A").alias("track"), F.col("event_type").alias("task"), F.when(F.col("user_id") % 2 == 0, "baseline").otherwise("treatment").alias("condition"),
        F.col("value").alias("tokens"), (F.col("event_id") % 3 > 0).alias("correct"),
    )


_EVALS = """
  e AS (SELECT 'A' AS track, event_type AS task, user_id % 2 = 0 AS b, value AS tokens, CASE WHEN event_id % 3 > 0 THEN 1.0 ELSE 0.0 END AS ok FROM events),
  p AS (SELECT track, task, avg(tokens) FILTER (b) AS baseline, avg(tokens) FILTER (NOT b) AS treatment, avg(ok) FILTER (b) AS bc, avg(ok) FILTER (NOT b) AS tc
    FROM e GROUP BY track, task)"""


def evaluation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.paired(_evals(spark, sf_dir))
    return found.select("track", "task", *[F.round(c, 6).alias(c) for c in ("baseline", "treatment", "reduction")], "wins")


EVALUATION_PAIRS = f"""WITH {_EVALS}
SELECT track, task, round(baseline, 6) AS baseline, round(treatment, 6) AS treatment, round((baseline - treatment) / baseline, 6) AS reduction,
  treatment < baseline AND tc >= bc AS wins FROM p WHERE baseline IS NOT NULL AND treatment IS NOT NULL"""


def evaluation_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    overhead = _table(spark, sf_dir, "region").select(F.lit("A").alias("track"), (F.col("r_regionkey") * 10).alias("tokens"))
    found = evaluate.net(evaluate.paired(_evals(spark, sf_dir)), overhead)
    return found.select("track", F.round("saved", 6).alias("saved"), "overhead", F.round("net", 6).alias("net"))


EVALUATION_NET = f"""WITH {_EVALS}, o AS (SELECT CAST(sum(r_regionkey * 10) AS BIGINT) AS overhead FROM region)
SELECT track, round(sum(baseline - treatment), 6) AS saved, any_value(overhead) AS overhead, round(sum(baseline - treatment) - any_value(overhead), 6) AS net
FROM p, o WHERE baseline IS NOT NULL AND treatment IS NOT NULL GROUP BY track"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 100."""
    rows = _table(spark, sf_dir, "embeddings")
    return rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, queries = _vectors(spark, sf_dir)
    found = vectors.top_k(rows, queries, k=10, vec="embedding", entry_id="vec_id")
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


def semantic_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answer from an inverted file, in its exact mode."""
    rows, queries = _vectors(spark, sf_dir)
    path = f"{checkpoint_folder(spark)}/cells-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    cells = vectors.InvertedFile.build(rows, path, vec="embedding", entry_id="vec_id")
    found = cells.search(rows, queries, k=10, exact=True, vec="embedding", entry_id="vec_id")
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


SEMANTIC_TOPK = """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
    FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"""


def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.to_json(F.create_map(F.concat_ws("/", "source", "doc_id"), F.sha2("text", 256))).alias("value"))
    broken = _table(spark, sf_dir, "benchmark").select(F.lit("{not json").alias("value"))
    return manifest.parse_manifest(rows.unionByName(broken))


MANIFEST_JSON = CONTENT_HASH


def index_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each type after files were indexed twice, and after a reset."""
    files, made = _document_files(spark, sf_dir), _new_collection(spark)
    index.index_files(made, files)
    index.index_files(made, files)
    twice = made.entries().groupBy("metadata.type").agg(F.count("*").alias("n")).withColumn("step", F.lit("twice"))
    index.index_files(made, files, reset=True)
    return twice.unionByName(index.type_counts(made.entries()).withColumn("step", F.lit("reset"))).select("step", "type", "n")


INDEX_MODES = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''),""" + _WINDOWS.format(step=40, size=50, lines="d") + """,
  t AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'code' ELSE 'doc' END AS type, count(*) AS n FROM win WHERE content <> '' GROUP BY 1)
SELECT 'twice' AS step, type, 2 * n AS n FROM t UNION ALL SELECT 'reset', type, n FROM t"""

#: name -> (query, SQL)
REGISTRY = {
    "chunk_lines": (chunk_lines, CHUNK_LINES), "chunk_markdown": (chunk_markdown, CHUNK_MARKDOWN), "char_chunks": (char_chunks, CHAR_CHUNKS),
    "heading_boundary": (heading_boundary, HEADING_BOUNDARY), "compress_gates": (compress_gates, COMPRESS_GATES), "compression_ratio": (compression_ratio, COMPRESSION_RATIO),
    "content_hash": (content_hash, CONTENT_HASH), "sync_diff": (sync_diff, SYNC_DIFF), "sync_counts": (sync_counts, SYNC_COUNTS), "sync_keep": (sync_keep, SYNC_KEEP),
    "sync_rechunk": (sync_rechunk, SYNC_RECHUNK), "manifest_removed": (manifest_removed, MANIFEST_REMOVED), "manifest_json": (manifest_json, MANIFEST_JSON),
    "tag_strip": (tag_strip, TAG_STRIP), "page_source": (page_source, PAGE_SOURCE), "hook_generic_select": (hook_generic_select, HOOK_GENERIC_SELECT),
    "json_leaves": (json_leaves, JSON_LEAVES), "route_decision": (route_decision, ROUTE_DECISION), "bash_gate": (bash_gate, BASH_GATE),
    "bash_write_back": (bash_write_back, BASH_WRITE_BACK), "generic_write_back": (generic_write_back, GENERIC_WRITE_BACK), "type_counts": (type_counts, TYPE_COUNTS),
    "collection_info": (collection_info, COLLECTION_INFO), "index_sync": (index_sync, INDEX_SYNC), "page_fetch": (page_fetch, PAGE_FETCH), "command_run": (command_run, COMMAND_RUN), "nested_write_back": (nested_write_back, NESTED_WRITE_BACK), "preview": (preview, PREVIEW), "dry_run": (dry_run, DRY_RUN), "file_filters": (file_filters, FILE_FILTERS),
    "ignore_rules": (ignore_rules, IGNORE_RULES), "ext_normalise": (ext_normalise, EXT_NORMALISE), "map_reduce_extractive": (map_reduce_extractive, MAP_REDUCE),
    "condense_rendered": (condense_rendered, CONDENSE_RENDERED), "classifier_answers": (classifier_answers, CLASSIFIER_ANSWERS),
    "evaluation_pairs": (evaluation_pairs, EVALUATION_PAIRS), "evaluation_net": (evaluation_net, EVALUATION_NET), "semantic_topk": (semantic_topk, SEMANTIC_TOPK), "semantic_cells": (semantic_cells, SEMANTIC_TOPK), "index_modes": (index_modes, INDEX_MODES),
}
REGISTRY |= service_queries.REGISTRY
