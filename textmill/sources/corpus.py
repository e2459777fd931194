"""A source that reads a file tree as rows: rel_path, abs_path, suffix, content, error.

Spark's ``binaryFile`` leaves out names that begin with ``_`` or ``.`` and empty files, so
this is a Python data source of its own. The driver lists the tree, folders side by side, and
deals files out by their bytes; what lies beyond ``listed_files`` of them is dealt out by folder
and listed by the tasks. Executors must see the same path. Filters on ``rel_path`` are pushed
down: named paths are looked up instead of listed. With ``digest`` a file is streamed through
SHA-256 and its content never held. As a stream the source gives each change of the tree.

A root in another store, with a scheme before its path, is listed by Hadoop's file system and
read by ``binaryFile`` (``read_corpus``).
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import stat
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StringType

from textmill.functions.paths import EXCLUDED_FOLDERS, compile_ignore, entry_type, extensions_of, is_ignored
from textmill.functions.storage import read_bytes
from textmill.functions.text import heading_sections, line_windows, split_lines

SCHEMA = "rel_path string, abs_path string, suffix string, content binary, error string"
DIGEST_SCHEMA = "rel_path string, abs_path string, suffix string, sha256 string, bytes long, error string"
#: Bytes and files of a part, and files that the driver lists.
PART_BYTES, PART_FILES, LISTED_FILES = 64 << 20, 4_096, 1_000_000


class Part(InputPartition):
    """Files by relative path, and folders whose trees the task lists itself."""

    def __init__(self, files: list[str], folders: list[str]):
        super().__init__(0)
        self.files, self.folders = files, folders


def _suffix(name: str) -> str:
    return os.path.splitext(name)[1].lower()


class Tree:
    """What belongs to a corpus below ``root``. Excluded and ignored folders aren't entered.

    A root that is a file is that file, whatever its name. ``strict_absolute`` also looks for
    excluded names above the root, which then holds nothing.
    """

    def __init__(self, root: str, extensions: list[str], exclude: list[str] | None = None, respect_ignore: bool = True, strict_absolute: bool = False, rules: str | None = None):
        remote = "://" in root
        self.root = root.rstrip("/") if remote else os.path.abspath(root)
        if not remote and not os.path.exists(self.root):
            raise FileNotFoundError(f"Error: {self.root} does not exist.")
        self.is_file = not remote and os.path.isfile(self.root)
        self.wanted, self.excluded, self.rules = set(extensions), {*EXCLUDED_FOLDERS, *(exclude or [])}, []
        self.nothing = strict_absolute and bool(self.excluded & set(self.root.split("/")))
        if respect_ignore and rules is None and not remote and os.path.isfile(at := os.path.join(self.root, ".gitignore")):
            with open(at, encoding="utf-8", errors="ignore") as f:
                rules = f.read()
        if respect_ignore and rules:
            self.rules = compile_ignore(rules.splitlines())
        # A rule that takes back may bring files of an ignored folder in again.
        self.takes_back = any(negated for _, negated in self.rules)

    def enters(self, folder: str) -> bool:
        return posixpath.basename(folder) not in self.excluded and (self.takes_back or not is_ignored(folder + "/x", self.rules))

    def holds(self, path: str) -> bool:
        """Whether a file of a folder that is entered belongs to the corpus."""
        name = posixpath.basename(path)
        return name not in self.excluded and _suffix(name) in self.wanted and not is_ignored(path, self.rules)

    def holds_below(self, path: str) -> bool:
        """The same for any relative path, by the folders above it."""
        parts = path.split("/")
        return self.holds(path) and all(self.enters("/".join(parts[:k])) for k in range(1, len(parts)))

    def list(self, below: str) -> tuple[list[tuple[str, int, int]], list[str]]:
        """(path, bytes, time of change) of the files, and the folders, of one folder, in order;
        links to folders aren't followed."""
        files, folders = [], []
        with os.scandir(os.path.join(self.root, below)) as found:
            for entry in sorted(found, key=lambda e: e.name):
                path = f"{below}/{entry.name}" if below else entry.name
                if entry.is_dir():
                    if not entry.is_symlink() and self.enters(path):
                        folders.append(path)
                elif self.holds(path):
                    try:
                        about = entry.stat()
                        files.append((path, about.st_size, about.st_mtime_ns))
                    except OSError:  # a link to nothing: reading it gives the error
                        files.append((path, 0, 0))
        return files, folders

    def walk(self, below: str) -> Iterator[str]:
        todo = [below]
        while todo:
            files, folders = self.list(todo.pop())
            yield from (path for path, _, _ in files)
            todo += reversed(folders)

    def listed(self, most: int, starts: Iterable[str] = ("",)) -> tuple[list[tuple[str, int, int]], list[str]]:
        """Files, level by level and folders side by side, until there are ``most``; then the folders left."""
        files: list[tuple[str, int, int]] = []
        folders = list(starts)
        with ThreadPoolExecutor(16) as pool:
            while folders and len(files) < most:
                now, folders = folders[:4_096], folders[4_096:]
                for own, below in pool.map(self.list, now):
                    files += own
                    folders += below
        return files, folders


def _tree(options: dict[str, str], rules: str | None = None) -> Tree:
    get = options.get
    listed = lambda key: [x.strip() for x in (get(key) or "").split(",") if x.strip()]
    return Tree(
        get("path") or get("root") or "", extensions_of(get("scope") or "both", listed("include")), listed("exclude"),
        (get("respect_ignore") or "true").lower() == "true", (get("strict_absolute") or "false").lower() == "true", rules,
    )


def deal(files: Iterable[tuple[str, int]], most_bytes: int, most_files: int) -> list[list[str]]:
    """Files in parts of at most so many bytes and files; a larger file is a part by itself."""
    parts: list[list[str]] = []
    held = 0
    for path, size in files:
        if not parts or len(parts[-1]) == most_files or held + size > most_bytes:
            parts.append([])
            held = 0
        parts[-1].append(path)
        held += size
    return parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.tree = _tree(options)
        number = lambda key, default: int(options.get(key) or default)
        self.bytes, self.files, self.most = number("bytes_per_partition", PART_BYTES), number("files_per_partition", PART_FILES), number("listed_files", LISTED_FILES)
        self.digest = (options.get("digest") or "false").lower() == "true"
        self.paths: list[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 (Spark's name)
        """Named paths and a beginning of the path are taken over, all else is left to Spark."""
        for f in filters:
            own = getattr(f, "attribute", None) == ("rel_path",)
            if own and isinstance(f, (EqualTo, In)):
                named = {x for x in (f.value if isinstance(f, In) else [f.value]) if x is not None}
                self.paths = sorted(named if self.paths is None else named & set(self.paths))
            elif own and isinstance(f, StringStartsWith) and not self.prefix:
                self.prefix = f.value
            else:
                yield f

    def partitions(self) -> list[Part]:
        tree = self.tree
        if tree.nothing:
            return [Part([], [])]
        if tree.is_file:
            name = os.path.basename(tree.root)
            return [Part([""] if name.startswith(self.prefix) and (self.paths is None or name in self.paths) else [], [])]
        if self.paths is not None:
            files, folders = [(p, size) for p in self.paths if p.startswith(self.prefix) and tree.holds_below(p) and (size := self._size(p)) is not None], []
        else:
            # A prefix with a slash begins in its folder.
            start = self.prefix.rpartition("/")[0]
            if start and not (os.path.isdir(os.path.join(tree.root, start)) and all(tree.enters("/".join(start.split("/")[: k + 1])) for k in range(start.count("/") + 1))):
                return [Part([], [])]
            found, folders = tree.listed(self.most, [start])
            files = [(p, size) for p, size, _ in found if p.startswith(self.prefix)]
        return [Part(part, []) for part in deal(files, self.bytes, self.files)] + [Part([], [f]) for f in folders] or [Part([], [])]

    def _size(self, path: str) -> int | None:
        """Bytes of what listing would find as a file there."""
        parts = path.split("/")
        if any(os.path.islink(os.path.join(self.tree.root, *parts[:k])) for k in range(1, len(parts))):
            return None
        try:
            about = os.lstat(at := os.path.join(self.tree.root, path))
            about = os.stat(at) if stat.S_ISLNK(about.st_mode) else about
            return None if stat.S_ISDIR(about.st_mode) else about.st_size
        except OSError:
            return None

    def read(self, partition: Part) -> Iterator[tuple]:
        below = (p for folder in partition.folders for p in self.tree.walk(folder) if p.startswith(self.prefix))
        for rel in chain(partition.files, below):
            yield _row(self.tree, rel, self.digest)


def _row(tree: Tree, rel: str, digest: bool = False) -> tuple:
    """A file's row; one that can't be read has an error instead of its content."""
    at = os.path.join(tree.root, rel) if rel else tree.root
    name = rel or os.path.basename(at)
    try:
        with open(at, "rb") as f:
            if digest:
                return name, at, _suffix(name), hashlib.file_digest(f, "sha256").hexdigest(), f.tell(), None
            return name, at, _suffix(name), f.read(), None
    except OSError as wrong:
        return (name, at, _suffix(name), None, None, str(wrong)) if digest else (name, at, _suffix(name), None, str(wrong))


class _StreamReader(DataSourceStreamReader):
    """Changes of a tree. An offset is the number of a listing, (path, bytes, time of change) of
    all files, kept in the folder of the option ``state``; a batch is the difference of two. It
    has a row with the content for each new or changed file and one without for each that went.

    After a restart a listing that no batch was made of is found in the folder and taken up.
    Listings before the last committed one are deleted.
    """

    def __init__(self, options: dict[str, str]):
        self.options, self.state = options, options.get("state") or ""
        if not self.state:
            raise ValueError("Error: a stream of a tree needs the option state, a folder for its listings.")
        self.bytes, self.files = int(options.get("bytes_per_partition") or PART_BYTES), int(options.get("files_per_partition") or PART_FILES)

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in os.listdir(self.state) if n.endswith(".json")) if os.path.isdir(self.state) else []

    def _listing(self, number: int) -> dict[str, list[int]]:
        if number <= 0:
            return {}
        with open(f"{self.state}/{number:010d}.json", encoding="utf-8") as f:
            return json.load(f)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        numbers = self._numbers()
        last = numbers[-1] if numbers else 0
        found, _ = _tree(self.options).listed(1 << 62)
        now = {path: [size, changed] for path, size, changed in found}
        if now != self._listing(last):
            os.makedirs(self.state, exist_ok=True)
            last += 1
            made = f"{self.state}/{last:010d}.tmp"
            with open(made, "w", encoding="utf-8") as f:
                json.dump(now, f)
            os.replace(made, f"{self.state}/{last:010d}.json")
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        was, now = self._listing(start["listing"]), self._listing(end["listing"])
        changed = [(p, about[0]) for p, about in now.items() if was.get(p) != about]
        gone = sorted(p for p in was if p not in now)
        parts = [Part(part, []) for part in deal(changed, self.bytes, self.files)]
        return parts + [Part([], gone[k : k + PART_FILES]) for k in range(0, len(gone), PART_FILES)] or [Part([], [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        tree = _tree(self.options)
        for rel in partition.files:
            row = _row(tree, rel)
            # A file that went since it was listed has gone; the next listing says so too.
            yield row if row[4] is None or os.path.exists(row[1]) else (*row[:4], None)
        for rel in partition.folders:  # here the files that went
            yield rel, os.path.join(tree.root, rel), _suffix(rel), None, None

    def commit(self, end: dict) -> None:
        for number in self._numbers():
            if number < end["listing"]:
                os.remove(f"{self.state}/{number:010d}.json")


class CorpusDataSource(DataSource):
    """Options: path, scope (code, docs, both), include and exclude (commas between), respect_ignore,
    strict_absolute, digest (hashes instead of contents), bytes_per_partition, files_per_partition,
    listed_files, and for a stream state."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return DIGEST_SCHEMA if (self.options.get("digest") or "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


def _registered(spark: SparkSession) -> None:
    """Make the source known, and let Spark push filters down to Python sources."""
    spark.dataSource.register(CorpusDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _remote_corpus(spark: SparkSession, root: str, options: dict[str, str]) -> DataFrame:
    """A tree in any store that Hadoop reads: the driver lists it by the store's own listing, tasks
    read by ``binaryFile``. A file that this reader passes over, as its name begins with a dot or
    an underscore, is a row with an error unless it is empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        raise FileNotFoundError(f"Error: {root} does not exist.")
    rules_at = jvm.org.apache.hadoop.fs.Path(at, ".gitignore")
    rules = read_bytes(spark, rules_at.toString()).decode("utf-8", "ignore") if fs.exists(rules_at) else ""
    tree = _tree(options | {"path": root}, rules)
    found: list[tuple[str, str, bool]] = []  # relative path, path, whether it is empty
    todo = [] if tree.nothing else [("", at)]
    while todo:
        below, folder = todo.pop()
        for about in fs.listStatus(folder):
            path, name = about.getPath(), about.getPath().getName()
            rel = f"{below}/{name}" if below else name
            if about.isDirectory():
                todo += [(rel, path)] if tree.enters(rel) else []
            elif rel == name and fs.getFileStatus(at).isFile() or tree.holds(rel):
                found.append((rel, path.toString(), about.getLen() == 0))
    digest = (options.get("digest") or "false").lower() == "true"
    if not found:
        return spark.createDataFrame([], DIGEST_SCHEMA if digest else SCHEMA)
    # ``binaryFile`` passes over empty files, so their rows come from the listing.
    full = [path for _, path, empty in found if not empty]
    names = spark.createDataFrame(found, "rel_path string, abs_path string, _empty boolean")
    contents = spark.read.format("binaryFile").load(full).select(F.col("path").alias("_path"), "content") if full else spark.createDataFrame([], "_path string, content binary")
    # A listed path and the source's path differ in the slashes after the scheme.
    key = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/*", "$1:/")
    rows = names.join(contents, key(F.col("abs_path")) == key(F.col("_path")), "left").withColumn("content", F.coalesce("content", F.when(F.col("_empty"), F.lit(b""))))
    rows = rows.withColumn("suffix", F.lower(F.regexp_extract("rel_path", r"[^/](\.[^./]+)$", 1))).withColumn("error", F.when(F.col("content").isNull(), "Error: Spark's readers pass over this file."))
    if digest:
        return rows.select("rel_path", "abs_path", "suffix", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), "error")
    return rows.select("rel_path", "abs_path", "suffix", "content", "error")


def read_corpus(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The files of a tree, or a single file. A file that can't be read is a row with an error."""
    if "://" in root:
        return _remote_corpus(spark, root, options)
    if not os.path.exists(root):
        raise FileNotFoundError(f"Error: {root} does not exist.")
    _registered(spark)
    return spark.read.format("corpus").options(path=root, **options).load()


def read_corpus_stream(spark: SparkSession, root: str, state: str, **options: str) -> DataFrame:
    """The changes of a tree as a stream, see ``_StreamReader``."""
    _registered(spark)
    return spark.readStream.format("corpus").options(path=root, state=state, **options).load()


@F.arrow_udf(StringType())
def decode_ignoring(content: pa.Array) -> pa.Array:
    """UTF-8 text without the bytes that aren't, with line ends made \\n; of a batch that is UTF-8
    no Python objects are made."""
    try:
        text = content.cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([None if c is None else c.decode("utf-8", "ignore") for c in content.to_pylist()], pa.string())
    for end in ("\r\n", "\r"):
        if pc.any(pc.match_substring(text, end)).as_py():
            text = pc.replace_substring(text, end, "\n")
    return text


def chunk_rows(files: DataFrame, path: str, text: str, *, size: int = 50, overlap: int = 10, keep_preamble: bool = False) -> DataFrame:
    """Chunks of (path, text) rows: content, metadata, start_line, end_line, chunk_no.

    Documents are cut at headings, all else into line windows.
    """
    lined = files.select(F.col(path).alias("_path"), entry_type(path).alias("_type"), split_lines(F.coalesce(F.col(text), F.lit(""))).alias("_lines"))
    lines = F.col("_lines")
    chunks = F.when(F.col("_type") == "doc", heading_sections(lines, size, overlap, keep_preamble)).otherwise(line_windows(lines, size, overlap))
    rows = lined.select("_path", "_type", F.posexplode(chunks).alias("chunk_no", "_chunk"))
    return rows.select(
        F.col("_chunk.content").alias("content"),
        F.struct(F.col("_path").alias("file_path"), F.concat_ws("-", "_chunk.start_line", "_chunk.end_line").alias("line_range"), F.col("_type").alias("type")).alias("metadata"),
        "_chunk.start_line", "_chunk.end_line", "chunk_no",
    )


def build_entries(spark: SparkSession, root: str, *, size: int = 50, overlap: int = 10, **options: str) -> DataFrame:
    """Chunks of all files of a tree; lazy, files that can't be read give none."""
    files = read_corpus(spark, root, **options).where(F.col("error").isNull())
    return chunk_rows(files.withColumn("text", decode_ignoring("content")), "rel_path", "text", size=size, overlap=overlap)
