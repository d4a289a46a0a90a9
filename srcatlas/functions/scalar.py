"""Scalar functions over columns: ids, hashes, path and module rules, weights and texts."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import time
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values
TEST_MARKS = ["test_", "_test.py", "_test.go", ".test.js", ".test.ts", ".spec.js", ".spec.ts", "/tests/", "/__tests__/"]
LANGUAGE_ENDINGS = {"python": [".py"], "javascript": [".js", ".jsx"], "typescript": [".ts", ".tsx"]}
FILE_ENDINGS = [".py", ".js", ".ts", ".go", ".tsx", ".jsx"]
TEST_WEIGHT, CODE_WEIGHT, GUIDE_WEIGHT = 0.5, 1.0, 1.5
CURSOR_SECONDS = 600
EMBEDDING_SIZES = {
    "voyage-4-large": 1024,
    "voyage-3-large": 1024,
    "voyage-code-3": 1024,
    "voyage-4": 1024,
    "voyage-3": 1024,
    "voyage-4-lite": 512,
    "voyage-3-lite": 512,
}


def _text(c: Column | str) -> Column:
    """Null counts as the empty string throughout: the data model has no null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def chunk_id(repo: Column, path: Column, symbol: Column, line: Column) -> Column:
    """First 16 bytes of sha256('repo:path:symbol:line') as 8-4-4-4-12 hex digits."""
    h = F.sha2(F.concat_ws(":", _text(repo), _text(path), _text(symbol), F.coalesce(line, F.lit(0)).cast("string")), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def content_hash(content: Column) -> Column:
    """Hex sha256 of the bytes; null stays null."""
    return F.sha2(content, 256)


def token_estimate(content: Column) -> Column:
    """Bytes of the UTF-8 text divided by 4, whole."""
    return F.floor(F.octet_length(_text(content)) / 4).cast("bigint")


def language(path: Column) -> Column:
    """Language by case-sensitive suffix, null for others."""
    return F.coalesce(*[F.when(any_of([path.endswith(e) for e in ends]), F.lit(name)) for name, ends in LANGUAGE_ENDINGS.items()])


def is_test_file(path: Column) -> Column:
    """Any mark as a substring of the lower-cased path."""
    p = F.lower(_text(path))
    return any_of([p.contains(m) for m in TEST_MARKS])


def retrieval_weight(path: Column) -> Column:
    return F.when(is_test_file(path), F.lit(TEST_WEIGHT)).otherwise(F.lit(CODE_WEIGHT))


def module_root_of(module: Column) -> Column:
    return F.element_at(F.split(_text(module), r"\.", 2), 1)


def module_rest_of(module: Column) -> Column:
    """All behind the first dot, or the empty string."""
    return F.coalesce(F.get(F.split(_text(module), r"\.", 2), F.lit(1)), F.lit(""))


def _without_double(parts: Column) -> Column:
    return F.when(
        (F.size(parts) > 1) & (F.get(parts, F.lit(0)) == F.get(parts, F.lit(1))), F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    ).otherwise(parts)


def module_of_path(path: Column) -> Column:
    """Dotted module of a file, stem included; a doubled first segment counts once."""
    return F.array_join(_without_double(F.split(F.regexp_replace(_text(path), r"\.[^./]*$", ""), "/")), ".")


def submodule_of_path(path: Column) -> Column:
    return F.coalesce(F.get(F.split(module_of_path(path), r"\."), F.lit(1)), F.lit(""))


def module_of_directory(path: Column) -> Column:
    """Dotted module of a file's directory; '.' at the root."""
    parts = F.split(F.regexp_replace(_text(path), r"(^|/)[^/]*$", ""), "/")
    joined = F.array_join(_without_double(parts), ".")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def embedding_text(header: Column, docstring: Column, content: Column) -> Column:
    """Header and documentation, where not empty, and content, a blank line apart."""
    return F.concat_ws("\n\n", F.nullif(_text(header), F.lit("")), F.nullif(_text(docstring), F.lit("")), _text(content))


def context_header(path: Column, parent: Column, siblings: bool) -> Column:
    """Place of a method for its embedding; empty without a parent class."""
    tail = "\n# Related methods in same class" if siblings else "\n"
    return F.when(
        _text(parent) != "", F.concat(F.lit("# File: "), _text(path), F.lit("\n# Class: "), _text(parent), F.lit(tail))
    ).otherwise(F.lit(""))


def query_hash(*parts: Column) -> Column:
    """First 8 bytes, in hex, of the sha256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[_text(p) for p in parts]), 256), 1, 16)


def cache_key(repo: Column, query: Column, version: Column, *scope: Column) -> Column:
    """Key of a cached answer. `scope` (module, tests, limit, offset) is part of the hash, so pages and filters never share one."""
    return F.concat(F.lit("query:"), _text(repo), F.lit(":"), query_hash(query, *scope), F.lit(":"), version.cast("string"))


def is_file_path(code: Column) -> Column:
    return code.contains("/") | any_of([code.endswith(e) for e in FILE_ENDINGS])


def is_symbol(code: Column) -> Column:
    return ~code.contains("/") & (code.rlike(r"^[A-Z][a-zA-Z0-9]+$") | code.rlike(r"^[a-z_][a-z0-9_]+$"))


def relation_reason(path: Column, chunk_path: Column, module: Column, kind: Column) -> Column:
    """Why a chunk relates to a file: directory, module, kind, else meaning."""
    parent = F.regexp_replace(_text(path), r"(^|/)[^/]*$", "")
    name = F.element_at(F.split(parent, "/"), -1)
    same = parent == F.regexp_replace(_text(chunk_path), r"(^|/)[^/]*$", "")
    return F.when(same, F.lit("same directory")).when(
        (name != "") & F.contains(_text(module), name), F.lit("same module")
    ).when(_text(kind) != "", F.concat(F.lit("similar "), kind)).otherwise(F.lit("semantically related"))


def short_hash(h: Column) -> Column:
    return F.substring(_text(h), 1, 8)


# -- values, not columns: what the caller has once per request


def embedding_size(model: str) -> int:
    """Vector length of a model, 512 for lite ones, 1024 otherwise."""
    return EMBEDDING_SIZES.get(model, 512 if model.endswith("-lite") else 1024)


def hash_query(*parts: str) -> str:
    return hashlib.sha256(":".join(parts).encode()).digest()[:8].hex()


def encode_cursor(query: str, offset: int, now: float | None = None) -> str:
    stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(time.time() if now is None else now))
    return base64.urlsafe_b64encode(json.dumps({"q": query, "o": offset, "t": stamp}, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str, query: str | None = None, now: float | None = None) -> int:
    """Offset in a cursor. Fails on bad encoding or format, after ten minutes, and for another query's cursor."""
    try:
        raw = base64.urlsafe_b64decode(cursor.encode())
    except ValueError as e:
        raise ValueError("invalid cursor encoding") from e
    try:
        x = json.loads(raw)
        made = time.mktime(time.strptime(x["t"], "%Y-%m-%dT%H:%M:%SZ")) - time.timezone
        offset = int(x["o"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("invalid cursor format") from e
    if (time.time() if now is None else now) - made > CURSOR_SECONDS:
        raise ValueError("cursor expired")
    if query is not None and x.get("q") != query:
        raise ValueError("cursor belongs to another query")
    return offset


def parse_duration(text: str) -> float:
    """Seconds of '7d', '24h', '1h30m', '45s' or '250ms'."""
    if m := re.fullmatch(r"(\d+)d", text):
        return int(m[1]) * 86400.0
    units = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"invalid duration {text!r}")
    return sum(float(a) * units[b] for a, b in parts)


def repo_of_path(path: str, root: str) -> str:
    """First segment below the folder of repositories, or the empty string."""
    base = root.rstrip("/") + "/"
    return path[len(base) :].split("/")[0] if path.startswith(base) else ""
