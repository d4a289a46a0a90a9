"""Symbols and relationships of source files, parsed once per file inside Arrow batches.

Python is read by the standard library's grammar, with an indentation scan where it fails; scripts by a token walk that
knows declarations, classes, methods, imports and calls. Spark spreads the files; a file is one row.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.lexing import COMMENT, NAME, NEWLINE, OP, STRING, decode_source, language_of, lex

SYMBOL_FIELDS = pa.struct(
    [
        ("symbol_name", pa.string()),
        ("kind", pa.string()),
        ("start_line", pa.int32()),
        ("end_line", pa.int32()),
        ("content", pa.string()),
        ("docstring", pa.string()),
        ("parent", pa.string()),
        ("signature", pa.string()),
    ]
)
RELATION_FIELDS = pa.struct(
    [("kind", pa.string()), ("source_name", pa.string()), ("source_line", pa.int32()), ("target_path", pa.string()), ("target_name", pa.string())]
)
SCHEMA = "repo string, path string, symbols array<struct<symbol_name:string,kind:string,start_line:int,end_line:int,content:string,docstring:string,parent:string,signature:string>>, relations array<struct<kind:string,source_name:string,source_line:int,target_path:string,target_name:string>>, error string"


def clean_docstring(raw: str) -> str:
    """One layer of quotes off; no trimming, and literals with a prefix stay as they are."""
    for q in ('"""', "'''"):
        if raw.startswith(q) and raw.endswith(q) and len(raw) >= 6:
            return raw[3:-3]
    return raw[1:-1] if len(raw) >= 2 and raw[0] == raw[-1] and raw[0] in "\"'" else raw


class _PythonFile:
    """Walks one module; offsets are UTF-8, as the grammar counts them."""

    def __init__(self, text: str):
        self.lines = text.encode().split(b"\n")
        self.symbols: list[dict] = []
        self.relations: list[dict] = []

    def slice(self, node: ast.AST) -> str:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return self.lines[a][node.col_offset : node.end_col_offset].decode("utf-8", "replace")
        return b"\n".join([self.lines[a][node.col_offset :], *self.lines[a + 1 : b], self.lines[b][: node.end_col_offset]]).decode("utf-8", "replace")

    def _doc(self, node) -> str:
        first = node.body[0]
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            return clean_docstring(self.slice(first.value))
        return ""

    def _signature(self, node, content: str) -> str:
        at = content.index("(", content.index(node.name))
        depth, i = 0, at
        for kind, a, b in lex(content[at:], "python"):
            c = content[at + a : at + b]
            if kind == OP and c in "([{":
                depth += 1
            elif kind == OP and c in ")]}":
                depth -= 1
                if depth == 0:
                    i = at + b
                    break
        returns = " -> " + self.slice(node.returns) if node.returns is not None else ""
        return "def " + node.name + content[at:i] + returns

    def add(self, node, kind: str, parent: str) -> None:
        content = self.slice(node)
        self.symbols.append(
            {
                "symbol_name": node.name,
                "kind": kind,
                "start_line": node.lineno,
                "end_line": node.end_lineno,
                "content": content,
                "docstring": self._doc(node),
                "parent": parent,
                "signature": "" if kind == "class" else self._signature(node, content),
            }
        )

    def walk_symbols(self, nodes: list[ast.AST]) -> None:
        """Functions at any depth with the enclosing function as parent; of a class only undecorated direct methods."""
        todo = [(n, "") for n in reversed(nodes)]  # a stack: expressions and blocks may nest deeper than Python recurses
        while todo:
            n, parent = todo.pop()
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.add(n, "function", parent)
                todo += [(c, n.name) for c in reversed(n.body)]
            elif isinstance(n, ast.ClassDef):
                self.add(n, "class", "")
                for m in n.body:
                    if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and not m.decorator_list:
                        self.add(m, "method", n.name)
            else:
                todo += [(c, parent) for c in reversed(list(ast.iter_child_nodes(n))) if isinstance(c, (ast.stmt, ast.excepthandler, ast.match_case))]

    def relate(self, kind: str, source: str, line: int, path: str = "", name: str = "") -> None:
        self.relations.append({"kind": kind, "source_name": source, "source_line": line, "target_path": path or None, "target_name": name or None})

    def _dotted(self, n: ast.AST) -> str:
        if isinstance(n, ast.Name):
            return n.id
        return self.slice(n) if isinstance(n, ast.Attribute) else ""

    def walk_relations(self, tree: ast.AST) -> None:
        todo = [(n, "") for n in reversed(list(ast.iter_child_nodes(tree)))]
        while todo:
            n, context = todo.pop()
            inner = context
            if isinstance(n, ast.Import):
                for a in n.names:
                    if a.asname is None:
                        self.relate("imports", context, n.lineno, path=a.name)
            elif isinstance(n, ast.ImportFrom):
                self.relate("imports", context, n.lineno, path="." * n.level + (n.module or ""))
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{context}.{n.name}" if context else n.name
                if isinstance(n, ast.ClassDef):
                    for base in n.bases:
                        if target := self._dotted(base):
                            self.relate("extends", n.name, n.lineno, name=target)
            elif isinstance(n, ast.Call) and context:
                if target := self._dotted(n.func):
                    self.relate("calls", context, n.lineno, name=target)
            todo += [(c, inner) for c in reversed(list(ast.iter_child_nodes(n)))]


def _scan_indentation(text: str) -> list[dict]:
    """Functions and classes of a file that the grammar rejects, by their indentation."""
    lines, open_, out = text.split("\n"), [], []
    for i, line in enumerate([*lines, "\0"]):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and indent <= open_[-1][0]:
            _, s, last = open_.pop()
            s["end_line"], s["content"] = last + 1, "\n".join(lines[s["start_line"] - 1 : last + 1]).lstrip()
        for o in open_:
            o[2] = i
        if m := re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)\s*(\([^)]*\))?", line):
            owner = open_[-1][1] if open_ else None
            kind = "class" if m[1] == "class" else "method" if owner and owner["kind"] == "class" else "function"
            s = {
                "symbol_name": m[2],
                "kind": kind,
                "start_line": i + 1,
                "end_line": i + 1,
                "content": line.strip(),
                "docstring": "",
                "parent": owner["symbol_name"] if owner and kind != "class" else "",
                "signature": "" if kind == "class" else f"def {m[2]}{m[3] or '()'}",
            }
            out.append(s)
            open_.append([indent, s, i])
    return out


def parse_python(text: str) -> tuple[list[dict], list[dict], str | None]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return _scan_indentation(text), [], f"syntax: {e}"[:200]
    f = _PythonFile(text)
    f.walk_symbols(tree.body)
    f.walk_relations(tree)
    return f.symbols, f.relations, None


_NO_CALL = {
    "if",
    "for",
    "while",
    "switch",
    "catch",
    "function",
    "return",
    "typeof",
    "await",
    "new",
    "super",
    "import",
    "do",
    "else",
    "with",
    "yield",
    "delete",
    "void",
    "in",
    "of",
    "case",
    "throw",
}
_STATEMENT_BEFORE = {"", ";", "{", "}", ")", "export", "default", "async", "else", "declare"}
_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*"}


def parse_script(text: str) -> tuple[list[dict], list[dict], str | None]:
    """Function declarations at any depth, classes with their direct methods, imports, extends and calls in a named context."""
    toks = [t for t in lex(text, "script") if t[0] not in (COMMENT, NEWLINE)]
    words = [text[a:b] for _, a, b in toks]
    n = len(toks)
    line_at = [0]
    for m in re.finditer("\n", text):
        line_at.append(m.end())
    from bisect import bisect_right

    def line(i: int) -> int:
        return bisect_right(line_at, toks[i][1])

    close: dict[int, int] = {}
    stack: list[int] = []
    inside = [-1] * n  # the bracket that directly encloses a token
    for i, w in enumerate(words):
        if toks[i][0] == OP and w in ")]}" and stack:
            close[stack.pop()] = i
        inside[i] = stack[-1] if stack else -1
        if toks[i][0] == OP and w in "([{":
            stack.append(i)
    symbols: list[dict] = []
    relations: list[dict] = []

    def body_after(i: int) -> int:
        """Index of the brace that opens the body behind a parameter list at i, -1 if there is none."""
        j = close.get(i, n) + 1
        while j < n and words[j] not in ("{", ";", "=>", "="):
            j += 1
        return j if j < n and words[j] == "{" else -1

    def add(kind: str, name: str, first: int, last: int, parent: str) -> None:
        a, b = toks[first][1], toks[last][2]
        symbols.append(
            {
                "symbol_name": name,
                "kind": kind,
                "start_line": line(first),
                "end_line": bisect_right(line_at, b - 1),
                "content": text[a:b],
                "docstring": "",
                "parent": parent,
                "signature": "",
            }
        )

    contexts: list[tuple[int, str]] = []  # index where it ends, name
    classes: list[tuple[int, int, str]] = []  # body start, end, name
    i = 0
    while i < n:
        while contexts and i > contexts[-1][0]:
            contexts.pop()
        while classes and i > classes[-1][1]:
            classes.pop()
        kind, w, before = toks[i][0], words[i], words[i - 1] if i else ""
        context = contexts[-1][1] if contexts else ""
        if kind == NAME and w == "function" and before in _STATEMENT_BEFORE and i + 2 < n and toks[i + 1][0] == NAME and words[i + 2] in ("(", "<"):
            at = next((k for k in range(i + 2, min(n, i + 60)) if words[k] == "("), -1)
            body = body_after(at) if at >= 0 else -1
            if body >= 0 and body in close:
                add("function", words[i + 1], i - 1 if before == "async" else i, close[body], "")
                contexts.append((close[body], f"{context}.{words[i + 1]}" if context else words[i + 1]))
                i = at
                continue
        elif kind == NAME and w == "class" and before in _STATEMENT_BEFORE and i + 1 < n and toks[i + 1][0] == NAME:
            body = next((k for k in range(i + 2, n) if words[k] == "{"), -1)
            if body in close:
                name = words[i + 1]
                add("class", name, i, close[body], "")
                head = words[i + 2 : body]
                if "extends" in head:
                    k = i + 2 + head.index("extends") + 1
                    if toks[k][0] == NAME:
                        target = words[k]
                        while words[k + 1] == "." and toks[k + 2][0] == NAME:
                            target, k = f"{target}.{words[k + 2]}", k + 2
                        relations.append({"kind": "extends", "source_name": name, "source_line": line(i), "target_path": None, "target_name": target})
                classes.append((body, close[body], name))
                contexts.append((close[body], name))
                i = body + 1
                continue
        elif kind == NAME and w == "import" and before not in (".",) and i + 1 < n and words[i + 1] != "(":
            k = i + 1
            while k < n and toks[k][0] != STRING and words[k] != ";":
                k += 1
            if k < n and toks[k][0] == STRING:
                relations.append(
                    {"kind": "imports", "source_name": context, "source_line": line(i), "target_path": words[k].strip("\"'`"), "target_name": None}
                )
                i = k
        elif classes and kind in (NAME, STRING) and i + 1 < n and words[i + 1] == "(" and (
            before in ("{", "}", ";") or before in _MODIFIERS
        ) and inside[i] == classes[-1][0]:
            body = body_after(i + 1)
            if body in close and w not in ("if", "for", "while", "switch", "catch"):
                first = i
                while words[first - 1] in _MODIFIERS and first - 1 > classes[-1][0]:
                    first -= 1
                add("method", w, first, close[body], classes[-1][2])
                contexts.append((close[body], f"{classes[-1][2]}.{w}"))
                i = body + 1
                continue
        elif kind == NAME and i + 1 < n and words[i + 1] == "(" and w not in _NO_CALL and before != "function":
            first, name = i, w
            while first >= 2 and words[first - 1] in (".", "?.") and toks[first - 2][0] == NAME:
                first, name = first - 2, f"{words[first - 2]}.{name}"
            whole = first == 0 or words[first - 1] not in (".", "?.")
            if name == "require" and i + 2 < n and toks[i + 2][0] == STRING:
                relations.append(
                    {
                        "kind": "imports",
                        "source_name": context,
                        "source_line": line(i),
                        "target_path": words[i + 2].strip("\"'`"),
                        "target_name": None,
                    }
                )
            elif context and whole and words[first - 1] != "new" and not (
                i + 1 in close and close[i + 1] + 1 < n and words[close[i + 1] + 1] == "{" and before in ("{", "}", ";", "async")
            ):
                relations.append({"kind": "calls", "source_name": context, "source_line": line(i), "target_path": None, "target_name": name})
        i += 1
    return symbols, relations, None


def parse_source(path: str, data: bytes | None) -> tuple[list[dict], list[dict], str | None]:
    """Symbols, relationships and an error; Go and unknown files give the error 'unsupported file type'."""
    language = language_of(path or "")
    if language not in ("python", "script"):
        return [], [], "unsupported file type"
    text = decode_source(data)
    return parse_python(text) if language == "python" else parse_script(text)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [parse_source(p, c) for p, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                b.column(1),
                pa.array([g[0] for g in got], pa.list_(SYMBOL_FIELDS)),
                pa.array([g[1] for g in got], pa.list_(RELATION_FIELDS)),
                pa.array([g[2] for g in got], pa.string()),
            ],
            ["repo", "path", "symbols", "relations", "error"],
        )


def parse_files(source_files: DataFrame) -> DataFrame:
    """(repo, path, symbols, relations, error) per row of source_files(repo, path, content); null content has neither."""
    return source_files.select("repo", "path", F.col("content").cast("binary").alias("content")).mapInArrow(_parse_batches, SCHEMA)


def file_symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo", F.col("path").alias("file_path"), F.inline("symbols"))


def file_relations(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo", F.col("path").alias("source_file"), F.inline("relations"))


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("repo", "path", "error")
