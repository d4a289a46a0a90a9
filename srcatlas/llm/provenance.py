"""Files that nobody wrote by hand here: generated, minified or bundled, third-party, or data stored as code.

Each file is lexed and its tokens are set out again in a canonical layout: one statement a line, indented by its depth,
with fixed gaps between tokens. Against that, the layout the file has tells: extreme expansion marks minified code; lines of a
few shapes, set out exactly as a printer would and counted through in several places at once, mark generated code; literals
that make up nearly all of the code mark data. Comments that speak of the whole file support the layout, and they and the
place of a file (its directories and what the modules table says of them) tell third-party copies, which have a
hand-written layout; a copy elsewhere of a third-party file is found by the hash of its code tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.lexing import COMMENT, NAME, NEWLINE, NUMBER, OP, STRING, decode_source, language_of, lex
from srcatlas.llm.common import spread

#: Statements per line and characters per line from which code counts as minified, and the least number of tokens.
MIN_EXPANSION, MIN_LINE_CHARS, MIN_TOKENS = 4.0, 120.0, 60
#: Share of lines of the few commonest shapes, and lines, from which code without a mark counts as generated.
MIN_UNIFORMITY, MIN_UNIFORM_LINES = 0.84, 12
#: Share of gaps between tokens that are as a printer would set them, counters of one record that run in step, and records,
#: from which uniform code counts as generated.
MIN_REGULARITY, MIN_COUNTERS, MIN_RECORDS = 0.97, 2, 6
#: Share of a file's code characters in literals and their separators, and number of literals, from which it counts as data.
MIN_TABLE_SHARE, MIN_TABLE_LITERALS = 0.9, 100
#: Share of a file's code characters in opaque literals, and their number, from which it counts as data.
MIN_LITERAL_SHARE, MIN_LITERAL_CHARS = 0.6, 400
HEAD_LINES = 12
MIN_COPY_TOKENS = 40

# -- wording of tools and of copies in leading and closing comments; fixed lists
TOOL_MARK = re.compile(
    r"""(?ix)
      code\ generated\ (?:by|from)\b | \bauto-?\s?generated\ (?:file|code|by|from|with|using|source)\b | \bautogenerated\b | \bautomatically\ (?:generated|created|produced)\b | @generated\b
    | \b(?:this|the)\ (?:file|code|module|source)\ (?:is|was|has\ been)\ (?:auto\w*\ )?(?:generated|produced|emitted|rendered|compiled)\ (?:automatically\ )?(?:by|from|with)\b
    | ^\W*(?:generated|built|compiled|produced|rendered|emitted)\ (?:by|from|with|using)\ \S+.{0,60}(?:\bby\b|\bfrom\b|\bon\ \d|\bwith\b|;|\brun\b|\bat\b|\.\ |v\d)
    | \bdo\ not\ (?:edit|modify|change|touch)\b(?=\W*$|\W+(?:this\ file|it\b|by\ hand|manually|directly|here)|\s*[;.,]|\s*:\s*(?:output|generated|produced|built)\b) | \bchanges\ (?:here\ |made\ here\ )?will\ be\ (?:lost|overwritten)\b | \bedit\ the\ source\ (?:definition|schema|template|file)\b
    | \bmachine[- ](?:made|generated|written)\b | \bregenerate\ with\b | \bto\ (?:refresh|regenerate)\b.{0,20}$
    | \bautomatisch\ (?:erzeugt|generiert|erstellt)\b | \bnicht\ (?:von\ hand|manuell)\ (?:bearbeiten|(?:ä|ae)ndern)\b | \bne\ pas\ (?:modifier|[ée]diter)\b | \b(?:est|a\ [ée]t[ée])\ (?:produit|g[ée]n[ée]r[ée])\ (?:automatiquement\ )?par\b | \bfichier\ g[ée]n[ée]r[ée]\b
    | \b(?:archivo|c[oó]digo)\ generado\b | \bgenerado\ (?:autom[aá]ticamente|por)\b | \bno\ (?:editar|modificar)\b | \bg[ée]n[ée]r[ée]\ (?:automatiquement|par)\b
    """
)
COPY_MARK = re.compile(
    r"""(?ix)
      \bupstream\ (?:release|copy|version|source) | \b(?:vendored|copied|imported|taken|mirrored|forked|synced)\ (?:\w+\ ){0,2}(?:from|out\ of)\ \S+ | \bsend\ fixes\ to\ (?:that|the)\ project
    | ^\s*/\*!\s*(?:\*\s*)?[\w.@/-]+\ v?\d+\.\d+ | @license\b.{0,60}\d+\.\d+ | \(c\)\ the\ \w+\ (?:contributors|authors) | \bcopyright\ \(c\)\ the\ [\w-]+\ (?:authors|contributors) | released\ under\ the\ \S+\ license
    | \blicensed\ under\ the\ .{0,40}\bof\ that\ project | \bv?\d+\.\d+(?:\.\d+)?\ \|\ (?:MIT|BSD|ISC|Apache|MPL)\b | \bunmodified\ copy\ of\b
    """
)
#: What speaks of a whole file, or of a bundle's part, also between statements, where "do not change" and "copied from" concern only what follows.
TOOL_BANNER = re.compile(
    r"""(?ix)
      ^\W*code\ generated\ (?:by|from)\b | \bauto-?\s?generated\ file\b | ^\W*(?:auto-?\s?generated|automatically\ (?:generated|created|produced))\ (?:code\ |source\ )?(?:by|from|with|using)\b | ^\W*@generated\b
    | \b(?:this|the)\ (?:file|module)\ (?:is|was|has\ been)\ (?:(?:auto\w*|machine)[ -]?)?(?:generated|produced|emitted|rendered|compiled)\ (?:automatically\ )?(?:by|from|with)\b
    | ^\W*(?:generated|built|compiled|produced|rendered|emitted)\ (?:by|from|with|using)\ \S+.{0,60}\bdo\ not\ (?:edit|modify|change|touch)\b | \bmachine[- ](?:made|generated|written)\ (?:file|module)\b
    | \bdiese\ datei\ (?:wurde|ist|wird)\ automatisch\ (?:erzeugt|generiert|erstellt)\b | \b(?:ce\ )?fichier\ (?:est\ |a\ [ée]t[ée]\ )?(?:produit|g[ée]n[ée]r[ée])\b | \barchivo\ generado\b
    """
)
COPY_BANNER = re.compile(
    r"(?i)^\s*/\*!\s*(?:\*\s*)?[\w.@/-]+\ v?\d+\.\d+|@license\b.{0,60}\d+\.\d+|\bv?\d+\.\d+(?:\.\d+)?\ \|\ (?:MIT|BSD|ISC|Apache|MPL)\b|\b(?:this|the)\ file\ (?:is|was)\ (?:vendored|copied|imported|taken|mirrored)\ from\b"
)
OWN_MARK = re.compile(r"(?i)\bpart of the [\w-]+ (?:service|project|team|repo)|\bcopyright of this repository|\bthis repository's maintainers")
#: Sentences about generated or vendored code in hand-written files.
ABOUT = re.compile(
    r"(?i)\bis not (?:one|generated|vendored)|\bhand[- ](?:tuned|written|made)|\breplaces the|\bfeeds the|\breads (?:the )?(?:vendored|generated)|\bcalls? (?:this|it)\b|\bplease edit\b"
)
THIRD_PARTY_TEXT = re.compile(
    r"(?i)\bupstream\b|\bthird[- ]party\b|\bunmodified copy\b|\bsynced from its authors\b|\bmirrored\b|\bvendored (?:copy|sources?)\b|\bcopy of the \S+ release\b"
)
GENERATED_TEXT = re.compile(r"(?i)\b(?:auto-?)?generated (?:code|files?|sources?|stubs?|bindings|by)\b|\boutput of\b|\bproduced by\b")
GENERATED_NAME = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.go|_pb\.(?:js|ts|d\.ts)|\.pb\.(?:js|ts)|\.(?:generated|gen|g|auto)\.[a-z]+|_generated\.[a-z]+|\.designer\.[a-z]+)$"
)
MINIFIED_NAME = re.compile(r"(?:[.-]min\.(?:js|css|mjs)|\.bundle\.(?:js|mjs)|\.[0-9a-f]{8,20}\.(?:js|mjs|css)|\.chunk\.js)$")
GENERATED_DIRECTORY = re.compile(r"(?:^|/)(?:__generated__|autogen|auto[_-]gen|gen-src|generated-sources?|_generated)/")
COPY_DIRECTORY = re.compile(
    r"(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|\.?venv|_vendor|vendored|third[_-]?party|thirdparty|extern(?:al)?s?/[^/]+-\d[\w.]*|extern|deps/[^/]+/(?:src|lib)|(?:vendor|deps)/[^/]+\.[a-z]+(?:/[^/]+)*|(?:vendor|deps|lib|libs)/[^/]+-\d+\.\d[\w.]*)/"
)
COPY_REPOSITORY = re.compile(r"(?i)^(?:third[-_]?party|vendored?|upstream|mirror)[-_]")

_WORDY = re.compile(r"[A-Za-z]{2,}(?:[\s_,.:;/()-]+[A-Za-z]{2,}){2,}")


#: Marks that have no gap before them, and after them, in canonical layout; unary signs and keywords keep theirs.
_TIGHT_BEFORE, _TIGHT_AFTER = set(",;:)].}") | {"++", "--", "?."}, set("([.!~@") | {"++", "--", "?.", "..."}
_FREE = set("=:-+*{}<>&|?/%^$#") | {"**", "=>", "->", ":=", "...", "<-"}
_TRAIL = re.compile(r"\d+$")
_BYTE_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-7]{3})")
_SEPARATORS = frozenset(",+-[](){}:")
_IMPORTS = frozenset(("import", "from", "package", "using", "require"))


def canonical_lines(text: str, tokens: list, language: str) -> Iterator[tuple[int, list]]:
    """(depth, tokens) of each line in canonical layout: a logical line in Python, else up to `;`, `{` or `}` outside parentheses."""
    line: list = []
    round_, depth = 0, 0
    for t in tokens:
        kind, a, b = t
        if kind == COMMENT:
            continue
        if kind == NEWLINE:
            if language == "python" and not round_ and line:
                yield depth, line
                line = []
            continue
        line.append(t)
        if kind != OP:
            continue
        c = text[a:b]
        if c in "([" or c == "{" and language == "python":
            round_ += 1
        elif c in ")]" or c == "}" and language == "python":
            round_ = max(0, round_ - 1)
        elif c == ";" and not round_:
            yield depth, line
            line = []
        elif c == "{":
            yield depth, line
            line, depth = [], depth + 1
        elif c == "}":
            depth = max(0, depth - 1)
            yield depth, line
            line = []
    if line:
        yield depth, line


def canonical_gap(before: str, after: str) -> str | None:
    """The gap between two tokens in canonical layout; None where both ways are usual."""
    if before in _FREE or after in _FREE:
        return None
    if after in _TIGHT_BEFORE or before in _TIGHT_AFTER:
        return ""
    if after in "([" or before in ")]}" or not (before[0].isalnum() or before[0] in "_\"'`,;"):
        return None
    return " "


def canonical_text(text: str, language: str) -> str:
    """The code set out in canonical layout, without comments."""
    out = []
    for depth, line in canonical_lines(text, lex(text, language), language):
        parts = [text[line[0][1] : line[0][2]]]
        for (_, a, b), (_, c, d) in zip(line, line[1:]):
            gap = canonical_gap(text[a:b], text[c:d])
            parts += [("" if text[c] in "([" and text[b - 1] not in _FREE else " ") if gap is None else gap, text[c:d]]
        out.append("  " * depth + "".join(parts))
    return "\n".join(out)


def _counters(text: str, records: list[list]) -> int:
    """Places at which the names or literals of records of one shape count on from record to record by a fixed step."""
    if len(records) < MIN_RECORDS:
        return 0
    running = None
    last: dict[int, tuple[str, int]] = {}
    for k, tokens in enumerate(records):
        now = {}
        for at, (kind, a, b) in enumerate(tokens):
            if kind in (NAME, STRING, NUMBER):
                m = _TRAIL.search(text[a:b].rstrip("\"'`"))
                if m and len(m[0]) < 9:
                    now[at] = int(m[0])
        if k:
            steps = {at: n - last[at] for at, n in now.items() if at in last}
            running = {at: d for at, d in steps.items() if d > 0} if running is None else {at: d for at, d in running.items() if steps.get(at) == d}
            if not running:
                return 0
        last = now
    return len(running or {})


def _regularity(text: str, lines: list[list]) -> float:
    """Share of the gaps within canonical lines that are as a printer would set them."""
    regular, gaps = 0, 0
    for line in lines:
        for (_, a, b), (_, c, d) in zip(line, line[1:]):
            want, have = canonical_gap(text[a:b], text[c:d]), text[b:c]
            if want is not None and "\n" not in have:
                gaps += 1
                regular += have == want
    return regular / max(1, gaps)


def _opaque(literal: str) -> bool:
    """Whether a string is no words but bytes: escapes for half of it, or a long run of letters and digits."""
    body = literal.lstrip("rRbBuUfF").strip("\"'`")
    if len(body) < 24:
        return False
    escapes = len(_BYTE_ESCAPE.findall(body)) if "\\" in body else 0
    if escapes * 4 >= 0.5 * len(body):
        return True
    return not re.search(r"\s", body) and not _WORDY.search(body) and len(set(body)) >= 10 and bool(re.search(r"\d", body))


@dataclass
class _Comments:
    """Comments by place: those of the first lines or before any code, between top-level statements, behind all code."""

    head: list[str]
    between: list[str]
    closing: list[str]


def _comments(text: str, language: str, toks: list, words: list[str]) -> _Comments:
    out = _Comments([], [], [])
    depth, braces, line, at, first, docstring, before = 0, 0, 0, 0, None, None, NEWLINE
    for (kind, a, _), word in zip(toks, words):
        fresh, before = before == NEWLINE, kind
        if kind == NEWLINE:
            continue
        if kind == COMMENT:
            line, at = line + text.count("\n", at, a), a
            alone = fresh and (language != "python" or a == 0 or text[a - 1] == "\n")
            if line < HEAD_LINES or first is None:
                out.head.append(word)
            elif alone:
                out.closing.append(word)
                if depth == braces == 0:
                    out.between.append(word)
            elif depth == braces == 0 and word.startswith("/*!"):
                out.between.append(word)
            continue
        if first is None:
            if kind == STRING and language == "python" and docstring is None:
                docstring = word
            else:
                first = a
        if out.closing:
            out.closing = []
        if kind == OP:
            if word in "([":
                depth += 1
            elif word in ")]":
                depth = max(0, depth - 1)
            elif word == "{":
                braces += 1
            elif word == "}":
                braces = max(0, braces - 1)
    if docstring is not None:
        out.head.append(docstring)
    return out


def layout(text: str, language: str) -> dict:
    """Measures of a file's layout against its canonical one; regularity and counters only of uniform files."""
    toks = lex(text, language)
    words = [text[a:b] for _, a, b in toks]
    lines: list[list] = [[]]
    shapes: list[list[str]] = [[]]  # tokens by kind: names keep no letters, literals no value
    code: list[str] = []
    chars, opaque, literal, literals, separators = 0, 0, 0, 0, 0
    for t, word in zip(toks, words):
        kind = t[0]
        if kind == NEWLINE:
            if lines[-1]:
                lines.append([])
                shapes.append([])
            continue
        if kind == COMMENT:
            continue
        lines[-1].append(t)
        code.append(word)
        size = len(word)
        chars += size
        if kind == NAME:
            shapes[-1].append("n")
        elif kind == OP:
            shapes[-1].append(word)
            if word in _SEPARATORS:
                separators += size
        else:
            shapes[-1].append("v")
            literal += size
            literals += 1
            if kind == NUMBER or _opaque(word):
                opaque += size
    full = lines if lines[-1] else lines[:-1]
    canonical = [line for _, line in canonical_lines(text, toks, language)]
    records: dict[str, list[list]] = {}
    for line, shape in zip(full, shapes):
        if text[line[0][1] : line[0][2]] not in _IMPORTS:
            records.setdefault(" ".join(shape), []).append(line)
    body_lines = sum(map(len, records.values()))
    # a record's lines repeat in a fixed order, so a few shapes may share the lines evenly
    often = [r for r in records.values() if len(r) >= max(3, 0.08 * body_lines)]
    uniformity = sum(map(len, often)) / max(1, body_lines)
    uniform = uniformity >= MIN_UNIFORMITY
    digest = None
    if len(code) >= MIN_COPY_TOKENS:
        digest = blake2b(" ".join(code).encode("utf-8", "replace"), digest_size=16).hexdigest()
    comments = _comments(text, language, toks, words)
    return {
        "tokens": len(code),
        "expansion": max(len(canonical), 1) / max(1, len(full)),
        "line_chars": chars / max(1, len(full)),
        "literal_share": (opaque + (separators if opaque > 0.4 * chars else 0)) / max(1, chars),
        "literal_chars": opaque,
        "table_share": (literal + separators) / max(1, chars),
        "literals": literals,
        "uniformity": uniformity,
        "regularity": _regularity(text, canonical) if uniform else 0.0,
        "counters": max((_counters(text, r) for r in often), default=0) if uniform else 0,
        "shapes": len(records),
        "body_lines": body_lines,
        "head": "\n".join(comments.head),
        "between": "\n".join(comments.between),
        "closing": "\n".join(comments.closing),
        "digest": digest,
    }


def layout_kind(m: dict) -> str | None:
    """What a file is by its layout alone."""
    opaque = m["literal_share"] >= MIN_LITERAL_SHARE and m["literal_chars"] >= MIN_LITERAL_CHARS
    if opaque or m["table_share"] >= MIN_TABLE_SHARE and m["literals"] >= MIN_TABLE_LITERALS:
        return "data"
    if m["expansion"] >= MIN_EXPANSION and m["line_chars"] >= MIN_LINE_CHARS and m["tokens"] >= MIN_TOKENS:
        return "minified"
    uniform = m["uniformity"] >= MIN_UNIFORMITY and m["body_lines"] >= MIN_UNIFORM_LINES and m["shapes"] <= 0.5 * m["body_lines"]
    return "generated" if uniform and m["regularity"] >= MIN_REGULARITY and m["counters"] >= MIN_COUNTERS else None


def marks(head: str) -> tuple[bool, bool, bool]:
    """(tool, copy, own) by the leading or closing comments, judged line by line."""
    tool = copy = own = False
    for line in head.split("\n"):
        if OWN_MARK.search(line):
            own = True
        elif not ABOUT.search(line):
            tool |= bool(TOOL_MARK.search(line.strip(" \t#/*!-").strip()) or TOOL_MARK.search(line))
            copy |= bool(COPY_MARK.search(line))
    return tool, copy or bool(COPY_MARK.search(" ".join(head.split()))) and not own and not ABOUT.search(head), own


def banners(between: str) -> tuple[bool, bool]:
    """(tool, copy) by the comments between top-level statements: only what speaks of the whole file or of a bundle's part."""
    lines = [x for x in between.split("\n") if not OWN_MARK.search(x) and not ABOUT.search(x)]
    return any(TOOL_BANNER.search(x.strip(" \t#/*!-").strip()) or TOOL_BANNER.search(x) for x in lines), any(COPY_BANNER.search(x) for x in lines)


def classify(path: str, data: bytes | None) -> tuple[str | None, bool, str | None, dict]:
    """(kind, own mark, digest of the code, measures) of one file by its content and name."""
    language = language_of(path)
    text = decode_source(data)
    m = layout(text, language or "script")
    tool, copy, own = marks(m["head"])
    for t, c in (marks(m["closing"])[:2] if m["closing"] else (False, False), banners(m["between"]) if m["between"] else (False, False)):
        tool, copy = tool or t, copy or c
    kind = layout_kind(m)
    if kind is None and (tool or copy):
        kind = "generated" if tool else "third-party"
    elif kind is None and not own and MINIFIED_NAME.search(path):
        kind = "minified"
    elif kind is None and not own and (GENERATED_NAME.search(path) or GENERATED_DIRECTORY.search(path)):
        kind = "generated"
    return kind, own, m["digest"], m


def _classify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [classify(p, c) for p, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        kinds, own, digests = (pa.array([g[k] for g in got], t) for k, t in ((0, pa.string()), (1, pa.bool_()), (2, pa.string())))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(3), kinds, own, digests], ["repo", "path", "version", "kind", "own", "digest"]
        )


def _third_party(text: Column) -> Column:
    return F.coalesce(text.rlike(THIRD_PARTY_TEXT.pattern), F.lit(False))


def file_provenance(files: DataFrame, source_files: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, path, origin, evidence) of each distinct file; origin is null for hand-written ones.

    Files without content are judged by name and place; content of paths that `files` lacks is ignored; of several contents
    of one path the one with the largest SHA-256 counts. A directory's description decides over its name: a module of the team's
    own keeps its files, one told to be third-party, or a repository whose described modules mostly are, gives them away.
    Null repo or path: left out. Only names, flags and hashes are shuffled, never contents.
    """
    wanted = files.where("repo is not null and path is not null").select("repo", "path").distinct()
    contents = spread(
        source_files.select(
            "repo", "path", "content", F.coalesce(F.sha2("content", 256), F.lit("")).alias("version")
        ).where("repo is not null and path is not null"),
        2,
    )
    judged = contents.mapInArrow(
        _classify_batches, "repo string, path string, version string, kind string, own boolean, digest string"
    ).groupBy("repo", "path").agg(F.max_by(F.struct("kind", "own", "digest"), "version").alias("c"))
    base = wanted.join(judged, ["repo", "path"], "left").select("repo", "path", "c.kind", F.coalesce("c.own", F.lit(False)).alias("own"), "c.digest")

    mods = modules.where("repo is not null and fs_path is not null and description is not null").select(
        "repo", F.regexp_replace("fs_path", "/+$", "").alias("dir"), _third_party(F.col("description")).alias("foreign")
    ).groupBy("repo", "dir").agg(F.max("foreign").alias("foreign"))
    repos = mods.groupBy("repo").agg((F.avg(F.col("foreign").cast("double")) > 0.5).alias("foreign_repo"))
    segments = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(segments) - 1, F.lit(1))), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/")
    )
    nearest = base.select("repo", "path", F.explode(prefixes).alias("dir")).join(mods, ["repo", "dir"]).groupBy("repo", "path").agg(
        F.max_by("foreign", F.length("dir")).alias("foreign"), F.max(F.length("dir")).alias("depth")
    )
    x = base.join(nearest, ["repo", "path"], "left").join(repos, "repo", "left")

    # a module that covers the copy's directory itself, and is the team's own, keeps the file
    copy_end = F.length(F.regexp_extract("path", "^(.*?" + COPY_DIRECTORY.pattern + ").*", 1))
    in_copy = F.col("path").rlike(COPY_DIRECTORY.pattern) & ~F.coalesce((F.col("depth") >= copy_end - 1) & ~F.col("foreign"), F.lit(False))
    in_generated = F.col("path").rlike(GENERATED_DIRECTORY.pattern) & F.col("kind").isNull()
    by_name = F.when(F.col("path").rlike(MINIFIED_NAME.pattern), "minified").when(
        F.col("path").rlike(GENERATED_NAME.pattern) | in_generated, "generated"
    )
    foreign = F.coalesce(F.col("foreign"), F.lit(False)) | (
        F.coalesce(F.col("foreign_repo"), F.lit(False))
    ) | F.col("repo").rlike(COPY_REPOSITORY.pattern)
    third = ~F.col("own") & (in_copy | foreign)
    origin = F.when(F.col("kind").isNotNull(), F.col("kind")).when(third, "third-party").when(~F.col("own"), by_name)
    evidence = F.when(F.col("kind").isNotNull(), "content").when(third & in_copy, "directory").when(third, "module").when(
        ~F.col("own") & by_name.isNotNull(), "name"
    )
    told = x.select("repo", "path", "own", "digest", origin.alias("origin"), evidence.alias("evidence"))
    sources = told.where("origin = 'third-party' and digest is not null").select("digest").distinct().withColumn("copied", F.lit(True))
    done = told.join(sources, "digest", "left")
    copied = F.col("origin").isNull() & ~F.col("own") & F.coalesce(F.col("copied"), F.lit(False))
    return done.select(
        "repo",
        "path",
        F.when(copied, "third-party").otherwise(F.col("origin")).alias("origin"),
        F.when(copied, "copy").otherwise(F.col("evidence")).alias("evidence"),
    )


def unwritten_files(files: DataFrame, source_files: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, path): distinct files that nobody wrote by hand here."""
    return file_provenance(files, source_files, modules).where("origin is not null").select("repo", "path")


def hand_written_files(files: DataFrame, source_files: DataFrame, modules: DataFrame) -> DataFrame:
    """The rows of `files` that remain."""
    return files.join(unwritten_files(files, source_files, modules), ["repo", "path"], "left_anti")
