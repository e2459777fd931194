"""Which files belong to a corpus: extensions, excluded folders, ignore patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import suffix

# Extensions of code and of documents, and folders that are never read.
CODE_SUFFIXES = (".c", ".cpp", ".cs", ".go", ".h", ".hpp", ".java", ".js", ".json", ".jsx", ".kt", ".php", ".py", ".rb", ".rs", ".scala", ".sh", ".sql", ".swift", ".ts", ".tsx", ".yaml", ".yml")
DOC_SUFFIXES = (".md", ".mdx", ".rst", ".txt")
EXCLUDED_FOLDERS = (".git", ".idea", ".next", ".venv", ".vscode", "__pycache__", "build", "coverage", "dist", "node_modules", "target", "vendor", "venv")

SCOPES = {"code": CODE_SUFFIXES, "docs": DOC_SUFFIXES, "both": CODE_SUFFIXES + DOC_SUFFIXES}


def normalise_extensions(extensions: list[str] | tuple[str, ...]) -> list[str]:
    """Lower case, a leading dot, no repeats; in the order given."""
    return list(dict.fromkeys(e if e.startswith(".") else f".{e}" for e in (x.lower() for x in extensions)))


def normalised(extensions: Column) -> Column:
    """The same rule for a column of lists."""
    low = F.transform(extensions, lambda x: F.lower(x))
    return F.array_distinct(F.transform(low, lambda x: F.when(F.startswith(x, F.lit(".")), x).otherwise(F.concat(F.lit("."), x))))


def extensions_of(scope: str = "both", include: list[str] | None = None) -> list[str]:
    """The include list if there is one, else the scope's extensions."""
    if include:
        return normalise_extensions(include)
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}; known are {', '.join(SCOPES)}")
    return list(SCOPES[scope])


def has_extension(path: str | Column, extensions: list[str]) -> Column:
    return suffix(path).isin(*extensions) if extensions else F.lit(False)


def in_excluded_folder(path: str | Column, extra: list[str] | None = None) -> Column:
    """Whether any part of a path is an excluded name; exact and case-sensitive."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/", -1)
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in dict.fromkeys([*EXCLUDED_FOLDERS, *(extra or [])])]))


def entry_type(path: str | Column) -> Column:
    return F.when(suffix(path).isin(*DOC_SUFFIXES), "doc").otherwise("code")


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (regular expression, whether it takes back), or None.

    A pattern with a slash inside is tied to the root; a last slash means folders only; *
    and ? don't cross a slash, ** does; what is below a matching folder matches too.
    """
    line = re.sub(r"(?<!\\)\s+$", "", pattern.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    tied = "/" in line
    line = line.lstrip("/")
    if not line:
        return None
    out, k = "", 0
    while k < len(line):
        if line.startswith("**/", k) and (k == 0 or line[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif line.startswith("/**", k) and k + 3 == len(line):
            out, k = out + "/.+", k + 3
        elif line[k] == "*":
            while k < len(line) and line[k] == "*":
                k += 1
            out += "[^/]*"
        elif line[k] == "?":
            out, k = out + "[^/]", k + 1
        elif line[k] == "[" and (end := line.find("]", k + 2)) > 0:
            body = line[k + 1 : end].replace("\\", "\\\\")
            out, k = out + ("[^" + body[1:] if body[0] in "!^" else "[" + body) + "]", end + 1
        elif line[k] == "\\" and k + 1 < len(line):
            out, k = out + re.escape(line[k + 1]), k + 2
        else:
            out, k = out + re.escape(line[k]), k + 1
    return f"^{'' if tied else '(?:.*/)?'}{out}{'/.+' if folder else '(?:/.*)?'}$", negated


def compile_ignore(lines: list[str]) -> list[tuple[str, bool]]:
    return [found for line in lines if (found := ignore_regex(line))]


def is_ignored(path: str, rules: list[tuple[str, bool]]) -> bool:
    """The last rule that matches decides."""
    hit = False
    for regex, negated in rules:
        if re.match(regex, path):
            hit = not negated
    return hit


def ignored(path: str | Column, rules: list[tuple[str, bool]]) -> Column:
    """The same as an expression over a column of relative paths."""
    at = F.col(path) if isinstance(path, str) else path
    hit = F.lit(False)
    for regex, negated in rules:
        hit = F.when(at.rlike(regex), F.lit(not negated)).otherwise(hit)
    return hit
