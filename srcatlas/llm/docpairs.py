"""Functions paired with their documentation.

Comment spans come from the source files, function spans from the symbols, each on its own. Every comment span carries
its anchor, the line of the code it abuts without a statement between; an as-of join in order of lines hands each function
the nearest span before it, and the pair stands only if the anchor is the function's first line. Pairs whose text says
nothing beyond names, types, stubs and labels are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions.lexing import decode_source, language_of
from srcatlas.llm.common import spread

#: Lines of a file that one sort of the as-of join holds.
BLOCK_LINES = 1024

_PY_STRING = r"(?:[rRuU]?)(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
_PY_SKIP = re.compile(
    r"(?P<def>(?m:^)[ \t]*(?:async[ \t]+)?def[ \t]+[^\W\d]\w*)|#[^\n]*|(?:[rRbBuUfF]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)"
)
_PY_HEADER = re.compile(
    r"[(\[{]|[)\]}]|:|#[^\n]*|(?:[rRbBuUfF]{0,2})(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|\n"
)
_PY_GAP = re.compile(r"(?:[ \t\f]|\\\n|\n|#[^\n]*)*")
_PY_DOC = re.compile(rf"(?P<s>{_PY_STRING}(?:[ \t]*(?:\\\n)?[ \t]*{_PY_STRING})*)[ \t]*(?=;|#|\n|\Z)")
_JS_SKIP = re.compile(
    r"/\*[\s\S]*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?|`(?:[^`\\]|\\[\s\S])*`?|/(?![/*])(?=(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*\s*[,;).\]])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"
)
_JS_GAP = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*")


def _header_end(text: str, at: int) -> int:
    """Offset behind the colon that ends a def header, -1 if there is none."""
    depth = 0
    for m in _PY_HEADER.finditer(text, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth <= 0:
            return m.end()
        elif c == "\n" and depth <= 0:
            return -1
    return -1


def _py_doc(text: str, at: int) -> re.Match | None:
    """The string that is the first statement after a header."""
    return _PY_DOC.match(text, _PY_GAP.match(text, at).end())


def comment_spans(text: str, language: str | None) -> list[tuple[int, int, str]]:
    """(anchor line, distance in lines, raw text) of documentation comments.

    Python: strings that are the first statement of a function body; the anchor is the line of `def`.
    Scripts: `/** */` blocks; the anchor is the line of the next code, the distance runs from the block's last line to it.
    """
    out = []
    if language == "python":
        at, line = 0, 1
        for m in _PY_SKIP.finditer(text):
            if m["def"] is None:
                continue
            line += text.count("\n", at, m.start())
            at = m.start()
            end = _header_end(text, m.end())
            doc = _py_doc(text, end) if end > 0 else None
            if doc:
                out.append((line, 0, doc["s"]))
    elif language == "script":
        at, line = 0, 1
        for m in _JS_SKIP.finditer(text):
            c = m[0]
            if not c.startswith("/**") or len(c) < 5:
                continue
            line += text.count("\n", at, m.end())
            at = m.end()
            code = _JS_GAP.match(text, m.end()).end()
            if code < len(text):
                gap = text.count("\n", m.end(), code)
                out.append((line + gap, gap, c))
    return out


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for repo, path, data in zip(*(c.to_pylist() for c in b.columns)):
            for anchor, gap, raw in comment_spans(decode_source(data), language_of(path)):
                for c, v in zip(cols, (repo, path, anchor, gap, raw)):
                    c.append(v)
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["repo", "file_path", "line", "gap", "raw"])


def parameter_text(content: str, python: bool) -> str:
    """The parameter list of a definition, with its return type."""
    at = content.find("(")
    if at < 0:
        return ""
    depth = 0
    for m in re.finditer(r"[(\[{]|[)\]}]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", content[at:]):
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth -= 1
            if depth == 0:
                end = at + m.end()
                tail = re.match(r"\s*->[ \t]*([^:\n]*)" if python else r"[ \t]*:[ \t]*([^{\n;]*)", content[end:])
                return content[at:end] + (" " + tail[1] if tail else "")
    return content[at:]


def _symbol_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        params, own = [], []
        for content, path in zip(b.column(5).to_pylist(), b.column(2).to_pylist()):
            content = (content or "").replace("\r\n", "\n")
            python = language_of(path or "") == "python"
            params.append(parameter_text(content, python))
            doc = None
            if python:
                m = re.match(r"\s*(?:async\s+)?def\b", content)
                end = _header_end(content, m.end()) if m else -1
                doc = _py_doc(content, end) if end > 0 else None
            own.append(doc["s"] if doc else None)
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:5], pa.array(params, pa.string()), pa.array(own, pa.string())],
            ["symbol_id", "repo", "file_path", "line", "symbol_name", "params", "inner"],
        )


# -- wording that says nothing; fixed lists
#: Words about the form of a description only.
FORM_WORDS = set(
    "a an the this that these of for with and or to is are be it its in on by as at from does do did has have function functions method methods class classes constructor constructors "
    "argument arguments arg args parameter parameters param params return returns returned raises raise throws yields yield rtype type types optional default defaults none null undefined void "
    "self cls this value values note notes example examples attributes property int integer str string float number bool boolean dict list tuple set any object array map promise self".split()
)
LABELS = re.compile(
    r"(?i)^(?:a |an |the )?(?:small |simple |internal |private |public |local |generic |basic |main |default |little )*(?:helper|helpers|internal|internals|utility|utilities|util|utils|wrapper|constructor|destructor|initiali[sz]er|getter|setter|accessor|callback|hook|handler|private|public|main|entry point|implementation|impl|misc|stuff|code|function|method|routine|procedure|stub|placeholder|dummy|docstring|documentation|description|summary|comment|doc|docs)(?: (?:function|method|class|routine|only|use|code|stub|here))*$"
)
DOC_NOUN = r"(?:docs?|docstrings?|documentation|documented|describe[ds]?|descriptions?|comments?|explanations?|explain(?:ed)?|text|summary|details?)"
MISSING = re.compile(
    rf"""(?ix)
      ^\W*(?:todo|fixme|xxx|tbd|tbc|hack|wip)\b(?:\(\w*\))?\W*(?:$|(?:[^.]*\b(?:{DOC_NOUN}|write|fill|arguments?|add)\b)|\w*\W*$)
    | ^\W*(?:un|not\ (?:yet\ )?|never\ |nobody\ .{{0,30}})documented\b | \b(?:no|missing|lacks?|without|needs?|awaiting|pending)\ (?:a\ |any\ |its\ |proper\ |further\ )*{DOC_NOUN}\b
    | \b{DOC_NOUN}\b.{{0,30}}\b(?:to\ follow|follows?|pending|missing|later|soon|to\ come|coming|needed|required|elsewhere|not\ (?:yet\ )?(?:available|written)|will\ be|to\ be\ (?:done|added|written))\b
    | \b(?:write|add|insert|enter|put|fill\ in)\ (?:a\ |the\ |some\ |proper\ |your\ )*{DOC_NOUN}\b | ^\W*(?:to\ be\ (?:done|written|documented|described)|coming\ soon|to\ follow|work\ in\ progress)\W*$
    | ^\W*(?:see|cf|refer\ to|same\ as|as|like|documented\ in|described\ in|inherited\ from|overrides|implements|inherit(?:s|ed)?)\s+(?:the\ |its\ |our\ )*(?:above|below|there|elsewhere|base|parent|super|super\ ?class|interface|class|module|docs?|documentation|wiki|readme|caller|code|source|name|title|signature|{{?@?inheritdoc}}?)\b[\w\ ]{{0,24}}\W*$
    | \{{?@inherit-?doc\}}? | ^\W*inherit(?:ed|doc|s)?\W*$ | \bself[- ]?explanatory\b | ^\W*(?:see|check)\ (?:above|below|elsewhere|there)\W*$
    """
)
STUB = re.compile(
    rf"(?i)\bauto-?\s?generated\b|^\W*(?:_+summary_+|_+description_+|_+type_+|\[summary\]|\[description\]|\[type\]|summary line|one[- ]line summary|short description|enter description here|describe (?:this|the) (?:function|method|class)(?: here)?|{DOC_NOUN} (?:of|for) \W*[\w.]+(?: (?:function|method|class))?|generated by \w+|method stub|insert description here|lorem ipsum.*)\W*$"
)
TAG_LINE = re.compile(
    r"@(?:param|arg|argument|property|prop|typedef|returns?|throws|type|template|yields|async|private|public|protected|function|method|memberof|class|constructor|static|readonly|override|export|name|kind|access|since|version|author|see|todo|deprecated)\b"
)
_WORD = re.compile(r"[^\W\d_]+")


def doc_text(raw: str) -> str:
    """The text inside a comment or string literal."""
    if raw.startswith("/**"):
        return "\n".join(re.sub(r"^\s*\*+ ?", "", x) for x in raw[3:].removesuffix("/").rstrip("*").split("\n")).strip()
    parts = re.findall(_PY_STRING, raw)
    return "".join(re.sub(r"^[rRuU]?(\"\"\"|'''|\"|')([\s\S]*)\1$", r"\2", p) for p in parts).strip() if parts else raw.strip()


def _split_name(name: str) -> set[str]:
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return {w.lower() for w in _WORD.findall(parts)} | {w.lower() for w in _WORD.findall(name)} | {w.lower() for w in re.findall(r"[^\W_]+", name)}


def says_something(text: str, name: str, params: str) -> bool:
    """Whether documentation holds more than names, types, stub text, labels and notes that it is missing."""
    known = FORM_WORDS | _split_name(name or "") | {name.lower() if name else ""}
    for w in re.findall(r"[^\W\d]\w*", params or ""):
        known |= _split_name(w)
    body = re.sub(r"\{[^{}\n]*\}", lambda m: " " if not re.search(r"inherit", m[0], re.I) else m[0], text)
    for line in re.split(r"\n|(?<=[.!?;])\s+", body):
        part = line.strip()
        if not _WORD.search(part) or MISSING.search(part) or STUB.search(part):
            continue
        part = TAG_LINE.sub(" ", part)
        part = re.sub(r"@description\b|:(?:param|type|returns?|rtype|raises)\b", " ", part)
        if LABELS.match(part.strip(" .:!*-#\t")):
            continue
        if any(len(w) > 1 and w.lower() not in known for w in _WORD.findall(part)):
            return True
    return False


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, keep = [], []
        for name, params, raw in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            t = doc_text(raw)
            texts.append(t)
            keep.append(says_something(t, name or "", params or ""))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(texts, pa.string())], ["symbol_id", "params", "documentation"]
        ).filter(pa.array(keep))


def _functions(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind in ('function', 'method') and symbol_id is not null and repo is not null and file_path is not null").select(
        "symbol_id", "repo", "file_path", F.col("start_line").cast("int").alias("line"), "symbol_name", "content", "indexed_at"
    )


def _version() -> Column:
    """Order of a symbol's rows: documentation and code are both taken from the last."""
    return F.struct("indexed_at", "line", "digest", "symbol_name", "repo", "file_path")


def documented_symbols(symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """(symbol_id, params, documentation) of each distinct function or method whose documentation says something.

    * of repeated symbols the row indexed last counts (ties: the last line, then content, name and place, in a fixed order); null ids and paths are left out;
    * a symbol whose file has no content keeps what its own content shows (Python bodies), else it has no documentation;
    * the stored docstring is not used; null and empty contents document nothing.
    Only names, parameter lists and comment texts are shuffled, never whole files or bodies.
    """
    s = _functions(symbols)
    s = spread(s, 2)
    heads = s.select("symbol_id", "repo", "file_path", "line", "symbol_name", "content", "indexed_at", F.sha2("content", 256).alias("digest")).mapInArrow(
        _with_time,
        "symbol_id bigint, repo string, file_path string, line int, symbol_name string, params string, inner string, indexed_at timestamp, digest string",
    )
    latest = heads.groupBy("symbol_id").agg(
        F.max_by(F.struct("repo", "file_path", "line", "symbol_name", "params", "inner"), _version()).alias("x")
    ).select("symbol_id", "x.*")
    files = spread(source_files.select("repo", "path", "content").where("repo is not null and path is not null and content is not null"), 2)
    spans = files.mapInArrow(_span_batches, "repo string, file_path string, line int, gap int, raw string").distinct()
    f = latest.select(
        "repo",
        "file_path",
        "line",
        F.lit(1).alias("is_function"),
        "symbol_id",
        "symbol_name",
        "params",
        "inner",
        F.lit(None).cast("struct<line:int,gap:int,raw:string>").alias("span"),
    )
    c = spans.select(
        "repo",
        "file_path",
        "line",
        F.lit(0).alias("is_function"),
        F.lit(None).cast("bigint").alias("symbol_id"),
        F.lit(None).cast("string").alias("symbol_name"),
        F.lit(None).cast("string").alias("params"),
        F.lit(None).cast("string").alias("inner"),
        F.struct("line", "gap", "raw").alias("span"),
    )
    # as-of: the nearest span at or before the function's first line; anchors keep a match within one block of lines
    w = Window.partitionBy(
        "repo", "file_path", F.floor(F.col("line") / BLOCK_LINES)
    ).orderBy("line", "is_function", F.desc("span.gap"), "span.raw").rowsBetween(Window.unboundedPreceding, 0)
    near = f.unionByName(c).withColumn("near", F.last("span", ignorenulls=True).over(w)).where("is_function = 1")
    script = ~F.col("file_path").rlike(r"\.pyi?$")
    fits = (F.col("near.line") == F.col("line")) & F.when(script, F.col("near.gap") == 1).otherwise(True)
    raw = F.when(fits, F.col("near.raw")).otherwise(F.col("inner"))
    pairs = near.select("symbol_id", "symbol_name", "params", raw.alias("raw")).where("raw is not null")
    return pairs.mapInArrow(_judge_batches, "symbol_id bigint, params string, documentation string")


def _with_time(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for out in _symbol_batches(iter([b.select(b.schema.names[:6])])):
            yield pa.RecordBatch.from_arrays([*out.columns, b.column(6), b.column(7)], [*out.schema.names, "indexed_at", "digest"])


def code_documentation_pairs(symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """(symbol_id, repo, symbol_name, code, documentation): the pairs, one row per symbol."""
    rows = _functions(symbols).withColumn("digest", F.sha2("content", 256))
    code = rows.groupBy("symbol_id").agg(
        F.max_by(F.struct("repo", "symbol_name", F.col("content").alias("code")), _version()).alias("c")
    ).select("symbol_id", "c.*")
    return code.join(documented_symbols(symbols, source_files).select("symbol_id", "documentation"), "symbol_id")
