"""Template residue, filler and error pages.

Character n-gram models of natural prose, code, notices, filler and unfilled slots: prose and code are counted over every
line of every document, the other three start from the exemplars of `exemplars.py` and are fitted again on the documents that
they mark themselves. A text is cut into windows of sentences and lines; the windows' likelihood ratios against prose and
code localise notices and filler, and the share of a text that such windows cover decides. Slots are localised in the same
way within a line: a span between marks counts if its n-grams, with those around it, are likelier in a slot than in prose,
and if it stands in prose, not in code, configuration, quotes or back-ticks. No phrase decides by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import spread
from srcatlas.llm.exemplars import FILLERS, NOTICES, ORDINARY, SLOTTED

#: Classes of bytes: letters, one class for digits, white space, line ends, these marks, other marks, all other bytes.
MARKS = b".,:;-_/'\"`()[]{}<>|=#*%@$"
SYMBOLS = 26 + 1 + 1 + 1 + len(MARKS) + 2
#: For slots upper-case letters are one class of their own.
SLOT_SYMBOLS = SYMBOLS + 1
TRIGRAMS, SLOTGRAMS = SYMBOLS**3, SLOT_SYMBOLS**3
#: Five-grams share hashed cells.
FIVEGRAMS = 1 << 19
PROSE, CODE, NOTICE, FILLER, SLOT_KIND, ORDINARY_SPAN = range(6)
SMOOTHING = 0.5
#: Weight of the background within the notice model, in counts; bound of one n-gram's log ratio.
PRIOR, CLIP = 2000.0, 4.0
#: Shares of a kind's own counts, of the background and of chance in the models of filler and slots.
MIX = (0.65, 0.3, 0.05)
#: Share of the ordinary spans in the model of prose that slots are compared with.
ORDINARY_SHARE = 0.2
#: Bytes of text that are scored at a time; a longer text is scored alone.
PART_BYTES = 1 << 22
#: Sentences that begin within the same stretch of this many bytes are one window.
WINDOW_BYTES = 32
#: Share of code marks from which a line is code.
CODE_MARKS, MIN_CODE_SHARE = b"(){}[];=<>_*/\"'#|`\\+&$@", 0.09
#: Mean log ratio from which a span is a slot; that of the spans the models are fitted on again.
SLOT_RATIO, LEARN_SLOT_RATIO = 0.25, 1.0
#: Bytes around a span that count: around one between marks, and around a word that stands for a missing value.
SLOT_AROUND, VALUE_AROUND = 3, 12
#: Bytes within a span, from either of its marks, that count: what lies between may be words of prose.
SLOT_EDGE = 12
#: Coverage, mean log ratio within it and bytes of a text from which it is a notice or filler.
DECIDE = {NOTICE: (0.6, 0.6, 8), FILLER: (0.5, 0.4, 12), SLOT_KIND: SLOT_RATIO}
#: The same for the documents that the models are fitted on again.
LEARN = {NOTICE: (0.7, 0.8, 16), FILLER: (0.5, 0.4, 24), SLOT_KIND: LEARN_SLOT_RATIO}
KINDS = {NOTICE: "notice", FILLER: "filler"}

# -- forms that a slot may have; whether one is a slot is for the model to say
SPANS = [
    re.compile(p)
    for p in (
        rb"\{\{[^{}\n]{1,60}\}\}", rb"\$\{[^{}\n]{1,60}\}", rb"#\{[^{}\n]{1,60}\}", rb"\{%[^%\n]{1,60}%\}", rb"\{(?<![$#{]\{)[ \w.\-]{1,40}\}(?!\})", rb"<%[^%\n]{1,60}%>",
        rb"<(?<!\w<)(?!(?:html|head|body|title|h[1-6r]|br|p|div|span|a|b|i|ul|ol|li|img|table|tr|td|th|pre|code|noscript|script|style|details|summary|sub|sup|kbd|meta|link|nav|main|form|input|button)>)\w[^<>\n=/\"|]{0,60}>",
        rb"\[\[[^\[\]\n]{1,60}\]\]", rb"\[(?<!\[\[)[A-Za-z][^\[\]\n=(){}\"]{1,60}\](?![(\[\]])", rb"\((?<![\w)\]]\()[A-Za-z]{3,}(?:[ _][A-Za-z]+){0,4}\)", rb"%[A-Za-z][A-Za-z_]{1,40}%", rb"#[A-Za-z][A-Za-z_]{1,40}#",
        rb"@@[A-Z][A-Z_]{1,40}@@", rb"__(?<!___)[A-Z][A-Z_]{1,40}__", rb"\$[A-Z][A-Z_]{2,40}\$", rb"____+(?<![A-Za-z0-9]____)(?!\w)", rb"\.\.\.\.\.+", rb"X(?<![\w.]X)\.Y(?:\.Z)?(?!\w)", rb"N(?<![\w.]N)\.N(?:\.N)?(?!\w)", rb"YYYY[-/.]MM[-/.]DD",
        rb"DD[-/.]MM[-/.]YYYY", rb"HH:MM", rb"XXX+(?!\w)", rb"\?\?\?+", rb"%s(?<!\w%s)(?!\w)", rb"%d(?<!\w%d)(?!\w)", rb"\[object Object\]", rb"Invalid Date\b", rb"undefined(?<!\wundefined)(?!\w)", rb"null(?<!\wnull)(?!\w)", rb"None(?<!\wNone)(?!\w)", rb"NaN(?<!\wNaN)(?!\w)",
    )
]
#: A line that asks its writer to write it.
ASKING_BYTES = 160
ASKING = re.compile(
    rb"(?im)[^\w\n]*(?:(?:todo|tbd|fixme|tbc)\b[^\w\n]*(?:please )?(?:fill|write|add|describe|complete|insert|document|enter|explain)?\b[^\n]{0,60}|(?:insert|your|add|enter|describe|write|fill in)\b[^\n]{0,40}\bhere\b[^\n]{0,12}|(?:to be (?:written|done|completed|filled in|defined))\W{0,3})$"
)
FENCE = re.compile(r"(?ms)^[ \t]*(`{3,}|~{3,}).*?(?:^[ \t]*\1[ \t]*$|\Z)")
QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|(?<![A-Za-z])'[^'\n]*'(?![A-Za-z])|“[^”\n]*”|«[^»\n]*»")
CONFIG_LINE = re.compile(
    r"^\s*(?:-\s*)?[a-z_][\w.\-]*\s*[:=](?:\s|$|[^/])|^\s*(?:export\s+)?[A-Z][A-Z0-9_]*=|^\s*\[[\w.\-]+\]\s*$|^\s*(?:#|;|//)|^\s*-\s+\S+$|^FROM |^RUN "
)
CODE_LINE = re.compile(
    r"^\s*(?:def|class|async|import|from|return|raise|if|elif|else|for|while|try|except|finally|with|assert|pass|del|function|const|let|var|export|throw|package|func|type|@\w|public|private|static|switch|case|break|continue)\b|[;{}]\s*$|^\s*[}\])]+|^\s*[\w.]+(?:\[[^\]]*\])?\s*[+\-*/]?=\s|^\s*[\w.]+\(.*\)\s*;?\s*$|^\s*(?:/\*|\*/|\*\s|//)|^\s*\"\"\"|^\s*'''"
)

HEADING, BETWEEN_MARKS = re.compile(r"#+ \S"), re.compile(r"[{<\[(]+[^\n]{1,60}?[}>\])]+")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    t = np.full(256, SYMBOLS - 1, np.int32)
    for i in range(26):
        t[ord("a") + i] = t[ord("A") + i] = i
    t[ord("0") : ord("9") + 1] = 26
    t[32] = t[9] = 27
    t[10] = t[13] = 28
    t[33:127] = np.where(t[33:127] == SYMBOLS - 1, SYMBOLS - 2, t[33:127])
    for i, c in enumerate(MARKS):
        t[c] = 29 + i
    u = t.copy()
    u[ord("A") : ord("Z") + 1] = SLOT_SYMBOLS - 1
    return t, u


TABLE, SLOT_TABLE = _tables()
#: First letters of undefined, null, None and NaN.
_VALUE_STARTS = np.frombuffer(b"unN", np.uint8)
_IS_MARK = np.isin(np.arange(256), np.frombuffer(CODE_MARKS, np.uint8))
#: Bytes that an asking line may begin with: no letters or digits but the first letters of its words.
_MAY_ASK = ~np.isin(np.arange(256), np.frombuffer(b"bcghjklmnopqrsuvxzBCGHJKLMNOPQRSUVXZ0123456789", np.uint8))
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\r\n", np.uint8))
_IS_END = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams, five-grams and slot trigrams that begin at each byte; the last bytes begin none and have cell 0."""
    n = len(data)
    three, five, slot = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    c, u = TABLE[data], SLOT_TABLE[data]
    if n > 2:
        three[:-2] = (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:]
        slot[:-2] = (u[:-2] * SLOT_SYMBOLS + u[1:-1]) * SLOT_SYMBOLS + u[2:]
    if n > 4:
        mixed = three[:-4].astype(np.uint32) * np.uint32(0x9E3779B1) + (c[3:-1] * SYMBOLS + c[4:]).astype(np.uint32) * np.uint32(0x85EBCA6B)
        five[:-4] = (mixed ^ (mixed >> np.uint32(15))) & np.uint32(FIVEGRAMS - 1)
    return three, five, slot


@dataclass
class Models:
    """Log ratios per n-gram: notices and filler against prose and code, slots against prose."""

    notice: np.ndarray
    filler: np.ndarray
    slot: np.ndarray


def empty_counts() -> list[np.ndarray]:
    """Counts per kind of trigrams, five-grams and slot trigrams."""
    return [np.zeros((6, TRIGRAMS)), np.zeros((6, FIVEGRAMS)), np.zeros((6, SLOTGRAMS))]


def models_of(counts: list[np.ndarray]) -> Models:
    """Notices by five-grams with the background as their prior; filler and slots by trigrams mixed with background and chance."""

    def log_share(x: np.ndarray) -> np.ndarray:
        return np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * len(x)))

    three, five, slot = counts
    base = np.exp(np.maximum(log_share(five[PROSE]), log_share(five[CODE])))
    notice = np.log((five[NOTICE] / base + PRIOR) / (five[NOTICE].sum() + PRIOR))

    def mixed(x: np.ndarray, back: np.ndarray) -> np.ndarray:
        own, behind, chance = MIX
        return np.log(own * x / max(1.0, x.sum()) / back + behind + chance / len(x) / back)

    filler = mixed(three[FILLER], np.exp(np.maximum(log_share(three[PROSE]), log_share(three[CODE]))))
    # prose as it is in the corpus and around ordinary spans between the same marks, of which a corpus may have few
    plain = (1 - ORDINARY_SHARE) * np.exp(log_share(slot[PROSE])) + ORDINARY_SHARE * slot[ORDINARY_SPAN] / max(1.0, slot[ORDINARY_SPAN].sum())
    slotted = mixed(slot[SLOT_KIND], plain)
    return Models(*(np.clip(x, -CLIP, CLIP).astype(np.float32) for x in (notice, filler, slotted)))


@dataclass
class _Batch:
    """The texts of a batch, end to end, with their windows."""

    data: np.ndarray
    ends: np.ndarray  # of texts
    starts: np.ndarray  # of windows
    text: np.ndarray  # text of each window

    @property
    def window_ends(self) -> np.ndarray:
        return np.append(self.starts[1:], len(self.data))


def _offsets(column: pa.Array) -> np.ndarray:
    """Where the bytes of each text of a string column begin, and end."""
    wide = pa.types.is_large_string(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)


def _parts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of a column in parts of about PART_BYTES of text, one row at least: what bounds the memory of a task."""
    column = column.fill_null("")
    at, first = _offsets(column), 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + PART_BYTES, side="right")) - 1)
        yield first, column.slice(first, end - first)
        first = end


def _batch(column: pa.Array) -> _Batch:
    column = column.fill_null("")
    at = _offsets(column)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    # sentences end behind a line end, or behind a full stop, question or exclamation mark before white space
    stop = data == 10
    stop[:-1] |= _IS_END[data[:-1]] & _IS_SPACE[data[1:]]
    begin = np.zeros(len(data) + 1, bool)
    begin[1:] = stop
    begin[at] = True
    pieces = np.flatnonzero(begin[:-1])
    text = np.searchsorted(at, pieces, side="right") - 1
    stretch = (pieces - at[text]) // WINDOW_BYTES
    new = np.ones(len(pieces), bool)
    new[1:] = (text[1:] != text[:-1]) | (stretch[1:] != stretch[:-1])
    return _Batch(data, at[1:], pieces[new], text[new])


def _line_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Offsets at which lines begin in texts that end at the given offsets."""
    begin = np.zeros(len(data) + 1, bool)
    begin[1:] = data == 10
    begin[0] = begin[ends] = True
    return np.flatnonzero(begin[:-1])


def _line_kinds(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """PROSE or CODE of the line of each byte, by its share of code marks."""
    starts = _line_starts(data, ends)
    size = np.diff(np.append(starts, len(data)))
    marks = np.add.reduceat(_IS_MARK[data].astype(np.int32), starts) if len(data) else size
    return np.repeat(np.where(marks >= MIN_CODE_SHARE * size, CODE, PROSE), size)


def _means(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean of values[a:b] for each pair of offsets, 0 where there is none."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    b = np.maximum(b, a)
    return (total[b] - total[a]) / np.maximum(b - a, 1)


def _edge_means(values: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Mean of values[low:left] and values[right:high] together, of values[low:high] where these meet."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    high = np.maximum(high, low)
    apart = (left < right) & (right < high)
    left, right = np.where(apart, left, high), np.where(apart, right, high)
    return (total[left] - total[low] + total[high] - total[right]) / np.maximum(left - low + high - right, 1)


def _covered(x: _Batch, score: np.ndarray, limits: tuple[float, float, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are residue of a kind by their windows' scores, and how far each is covered."""
    n = len(x.ends)
    solid = np.concatenate([[0], np.cumsum(~_IS_SPACE[x.data])])
    weight = (solid[x.window_ends] - solid[x.starts]).astype(float)
    inside = np.where(score > 0, weight, 0.0)
    size, cover, strength = (np.bincount(x.text, w, n) for w in (weight, inside, inside * score))
    share = cover / np.maximum(size, 1)
    return (share >= limits[0]) & (strength >= limits[1] * cover) & (size >= limits[2]), share


def judge_batch(column: pa.Array, models: Models, decide: dict = DECIDE) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int] | None], _Batch]:
    """Kind (0 for none), coverage and first span of residue of each text."""
    x = _batch(column)
    n = len(column)
    three, five, slot = _grams(x.data)
    ends, lines = x.window_ends, _line_kinds(x.data, x.ends)
    kind, cover = np.zeros(n, np.int32), np.zeros(n)
    where: list[tuple[int, int] | None] = [None] * n
    for k, values, size in ((NOTICE, models.notice[five], 5), (FILLER, models.filler[three], 3)):
        score = _means(values, x.starts, ends - size + 1)
        if k == FILLER:  # filler stands where prose would; a window that begins in code is none
            score = np.where(lines[np.minimum(x.starts, len(lines) - 1)] == PROSE, score, np.minimum(score, 0.0)) if len(lines) else score
        found, share = _covered(x, score, decide[k])
        new = found & (kind == 0)
        kind[new], cover[new] = k, share[new]
        for i in np.flatnonzero((score > 0) & new[x.text])[::-1]:
            where[x.text[i]] = (int(x.starts[i]), int(ends[i]))
    begins = np.append(0, x.ends[:-1])
    for i, (a, b, size) in _slots(x, begins, models.slot[slot], column, decide[SLOT_KIND]).items():
        if not kind[i]:
            kind[i], cover[i], where[i] = SLOT_KIND, size / max(1, x.ends[i] - begins[i]), (a, b)
    return kind, cover, where, x


def _slots(x: _Batch, begins: np.ndarray, ratio: np.ndarray, column: pa.Array, least: float) -> dict[int, tuple[int, int, int]]:
    """Texts with slots in their prose: (start, end) of the first one and bytes of all."""
    found = _spans(x.data, x.ends)
    if not found:
        return {}
    a, b = np.asarray(found).T
    text = np.searchsorted(x.ends, a, side="right")
    around = np.where(np.isin(x.data[a], _VALUE_STARTS), VALUE_AROUND, SLOT_AROUND)
    low, high = np.maximum(a - around, begins[np.minimum(text, len(begins) - 1)]), np.minimum(b + around, x.ends[np.minimum(text, len(begins) - 1)])
    score = _edge_means(ratio, low, high - 2, a + SLOT_EDGE, b - SLOT_EDGE)
    keep = (b <= x.ends[text]) & (score >= least)
    out: dict[int, tuple[int, int, int]] = {}
    for i in np.unique(text[keep]).tolist():
        prose = prose_of(column[i].as_py())
        for k in np.flatnonzero(keep & (text == i)).tolist() if prose else ():
            if x.data[a[k] : b[k]].tobytes().decode(errors="replace") in prose:
                first = out.get(i)
                out[i] = (int(a[k]), int(b[k]), int(b[k] - a[k])) if first is None else (first[0], first[1], first[2] + int(b[k] - a[k]))
    return out


def code_share(lines: list[str]) -> float:
    return sum(bool(CODE_LINE.search(x)) for x in lines) / max(1, len(lines))


def prose_of(text: str) -> str:
    """The text without code fences, quotes and back-ticked spans; empty for code and configuration."""
    bare = FENCE.sub("\n", text) if "```" in text or "~~~" in text else text
    lines = [x for x in bare.split("\n") if x.strip()]
    if not lines:
        return ""
    config = sum(bool(CONFIG_LINE.search(x)) and not HEADING.match(x) for x in lines) / len(lines)
    if code_share([BETWEEN_MARKS.sub("X", x) for x in lines]) >= 0.5 or config >= 0.6:
        return ""
    return QUOTED.sub(" ", bare)


def _add(counts: list[np.ndarray], kind: int, grams: tuple, keep: np.ndarray, times: int = 1) -> None:
    for table, cells in zip(counts, grams):
        table[kind] += times * np.bincount(cells[keep], minlength=table.shape[1])


def _exemplar_counts() -> list[np.ndarray]:
    """Counts of the exemplars; in those of slots only the span between the marks, and what is next to it, counts."""
    counts = empty_counts()
    for kind, texts in ((NOTICE, NOTICES), (FILLER, FILLERS)):
        data = np.frombuffer("\n".join(texts).encode(), np.uint8)
        _add(counts, kind, _grams(data), np.arange(len(data)) < len(data) - 4)
    for kind, texts in ((SLOT_KIND, SLOTTED), (ORDINARY_SPAN, ORDINARY)):
        data = np.frombuffer("\n".join(texts).encode(), np.uint8)
        _add(counts, kind, _grams(data), _near_spans(data, _spans(data, np.array([len(data)]))))
    return counts


def _spans(data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """All spans of the forms, in order."""
    found = [m.span() for p in SPANS for m in p.finditer(data)]
    starts = _line_starts(data, ends)
    short = starts[np.diff(np.append(starts, len(data))) <= ASKING_BYTES]
    short = short[_MAY_ASK[data[short]]]
    found += [m.span() for m in (ASKING.match(data, a) for a in short.tolist()) if m]
    return sorted(found)


def _near_spans(data: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    near = np.zeros(len(data), bool)
    for a, b in spans:
        around = VALUE_AROUND if data[a] in _VALUE_STARTS else SLOT_AROUND
        near[max(0, a - around) : max(0, b + around - 2)] = True
    return near


def _rows(counts: list[np.ndarray]) -> pa.RecordBatch:
    kind, cell, n, first = [], [], [], 0
    for table in counts:
        k, c = np.nonzero(table)
        kind.append(k), cell.append(c + first), n.append(table[k, c])
        first += table.shape[1]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(kind), pa.int32()), pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(n).astype(np.int64))],
        ["kind", "cell", "n"],
    )


def _background_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of prose and code lines."""
    counts = empty_counts()
    for b in batches:
        for _, part in _parts(b.column(0)):
            x = _batch(part)
            grams, kinds = _grams(x.data), _line_kinds(x.data, x.ends)
            _add(counts, PROSE, grams, kinds == PROSE)
            _add(counts, CODE, grams[:2], kinds == CODE)
    yield _rows(counts)


def _marked_batches(models_bc):
    """Partial counts of what the models mark, and of the lines that are no background after all, as negative counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = empty_counts()
        for b in batches:
            for _, part in _parts(b.column(0)):
                kind, _, where, x = judge_batch(part, models_bc.value, LEARN)
                if not kind.any():
                    continue
                grams, lines = _grams(x.data), _line_kinds(x.data, x.ends)
                of_byte = np.repeat(kind, np.diff(np.append(0, x.ends)))
                slots = _near_spans(x.data, [w for w, k in zip(where, kind) if k == SLOT_KIND])
                for k, keep in ((NOTICE, of_byte == NOTICE), (FILLER, of_byte == FILLER), (SLOT_KIND, slots)):
                    _add(counts, k, grams, keep)
                gone = (of_byte == NOTICE) | (of_byte == FILLER) | slots
                for k in (PROSE, CODE):
                    _add(counts, k, grams[: 3 if k == PROSE else 2], gone & (lines == k), -1)
        yield _rows(counts)

    return run


def _sums(partial: DataFrame) -> list[np.ndarray]:
    """Counts of all tasks: at most one number per kind and cell reaches the driver."""
    got = partial.groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    kind, cell, n = (got[c].to_numpy() for c in ("kind", "cell", "n"))
    counts, first = empty_counts(), 0
    for table in counts:
        here = (cell >= first) & (cell < first + table.shape[1])
        table[kind[here], cell[here] - first] = n[here]
        first += table.shape[1]
    return counts


def fit_models(documents: DataFrame, rounds: int = 1) -> Models:
    """The models over all documents: one count of the background, then `rounds` counts of what the models mark."""
    schema = "kind int, cell int, n bigint"
    texts = documents.select("text")
    exemplars = _exemplar_counts()
    background = _sums(texts.mapInArrow(_background_batches, schema))
    models = models_of([a + b for a, b in zip(exemplars, background)])
    for _ in range(rounds):
        bc = documents.sparkSession.sparkContext.broadcast(models)
        marked = _sums(texts.mapInArrow(_marked_batches(bc), schema))
        models = models_of([np.maximum(a + b + c, 0) for a, b, c in zip(exemplars, background, marked)])
    return models


def _judge_batches(models_bc):
    labels = {**KINDS, SLOT_KIND: "slot"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in _parts(b.column(1)):
                kind, cover, where, x = judge_batch(part, models_bc.value)
                names = [labels.get(k) for k in kind.tolist()]
                evidence = [x.data[w[0] : w[1]].tobytes().decode(errors="replace").strip() if w and k else "" for w, k in zip(where, names)]
                columns = [pa.array(names, pa.string()), pa.array(np.where(kind > 0, cover, 0.0), pa.float64()), pa.array(evidence, pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), *columns], ["doc_id", "residue", "coverage", "evidence"])

    return run


def judge_residue(documents: DataFrame) -> DataFrame:
    """(doc_id, residue, coverage, evidence) of every document; residue is slot, filler, notice or null.

    Null, empty and blank texts have none. Whole texts are judged, of whatever length; repeated rows give repeated rows.
    """
    d = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    models = documents.sparkSession.sparkContext.broadcast(fit_models(d))  # three arrays, one number per cell
    return d.mapInArrow(_judge_batches(models), "doc_id bigint, residue string, coverage double, evidence string")


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id): distinct documents to exclude."""
    return judge_residue(documents).where("residue is not null").select("doc_id").distinct()


def clean_documents(documents: DataFrame) -> DataFrame:
    """The documents without residue, all columns and rows kept as they are."""
    return documents.join(residue_documents(documents), "doc_id", "left_anti")
