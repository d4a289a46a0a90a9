"""A small lexer for Python, JavaScript, TypeScript and Go: token kinds and offsets, tolerant of broken input."""

from __future__ import annotations

import re

#: Token kinds.
COMMENT, STRING, NUMBER, NAME, OP, NEWLINE = "comment", "string", "number", "name", "op", "newline"
Token = tuple[str, int, int]

_PY = re.compile(
    r"""(?x)
      (?P<comment>\#[^\n]*)
    | (?P<string>(?:[rRbBuUfFtT]{1,2})?(?:\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z)))
    | (?P<number>(?:0[xXbBoO][0-9a-fA-F_]+|\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?[jJ]?|\.\d+(?:[eE][+-]?\d+)?))
    | (?P<name>[^\W\d]\w*)
    | (?P<newline>\n)
    | (?P<op>->|:=|\*\*=?|//=?|[<>!=]=|<<=?|>>=?|\.\.\.|[-+*/%&|^@]=|[^\w\s])
    """
)
_C = re.compile(
    r"""(?x)
      (?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\A\#![^\n]*)
    | (?P<string>"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z))
    | (?P<template>`)
    | (?P<number>(?:0[xXbBoO][0-9a-fA-F_]+n?|\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?n?|\.\d+(?:[eE][+-]?\d+)?))
    | (?P<name>[^\W\d][\w$]*|\$[\w$]*|\#[A-Za-z_]\w*)
    | (?P<newline>\n)
    | (?P<op>=>|\?\?=?|\?\.|\*\*=?|===|!==|[<>!=]=|<<=?|>>>?=?|&&=?|\|\|=?|\+\+|--|\.\.\.|:=|<-|[-+*/%&|^]=|[^\w\s])
    """
)
#: Names after which a slash begins a regular expression, not a division.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "instanceof", "yield", "await"}
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")


def language_of(path: str) -> str | None:
    """python, script or go by the suffix, else None."""
    if path.endswith((".py", ".pyi")):
        return "python"
    if path.endswith((".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")):
        return "script"
    return "go" if path.endswith(".go") else None


def _template_end(text: str, at: int) -> int:
    """Offset behind a template literal that opens at `at`; nested `${ }` may hold further templates."""
    i, n, depth = at + 1, len(text), []
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if not depth or depth[-1] == -1:
            if c == "`":
                if not depth:
                    return i + 1
                depth.pop()
            elif c == "$" and text[i + 1 : i + 2] == "{":
                depth.append(0)
                i += 1
        elif c == "`":
            depth.append(-1)
        elif c == "{":
            depth[-1] += 1
        elif c == "}":
            if depth[-1] == 0:
                depth.pop()
            else:
                depth[-1] -= 1
        i += 1
    return n


def lex(text: str, language: str) -> list[Token]:
    """Tokens as (kind, start, end); white space is left out, line ends are tokens."""
    if language == "python":
        return [(m.lastgroup, *m.span()) for m in _PY.finditer(text)]
    out: list[Token] = []
    at, n, last = 0, len(text), ("", 0, 0)
    while at < n:
        begin = at
        for m in _C.finditer(text, begin):
            kind = m.lastgroup
            a, at = m.span()
            if kind == "template":
                kind, at = STRING, _template_end(text, a)
            elif kind == OP and language == "script" and text[a] == "/":
                word = text[last[1] : last[2]]
                before = last[0] in ("", OP) and word not in (")", "]", "}") or last[0] == NAME and word in _BEFORE_REGEX
                r = _REGEX.match(text, a) if before else None
                if r:
                    kind, at = STRING, r.end()
            out.append((kind, a, at))
            if kind not in (COMMENT, NEWLINE):
                last = out[-1]
            if at != m.end():  # the token is longer than its pattern: go on behind it
                break
        else:
            break
    return out


def decode_source(data: bytes | None) -> str:
    """Text of a source file: byte order mark dropped, line ends as \\n, bytes that are not UTF-8 replaced."""
    if not data:
        return ""
    return data.decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n")


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]
