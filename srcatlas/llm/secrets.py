"""Credentials embedded in source code and configuration.

A text is scanned by patterns for the value (issued key formats, addresses with a password, private key blocks), for the
name or words before a value, and layer by layer: literals in base64, hex, percent or backslash escapes are decoded and
scanned again until a layer decodes no further (every layer is shorter than the one around it), and decoded bytes are read
by the grammar of key containers (DER sequences, the OpenSSH container). Encoded literals that the code joins are decoded
as one. A hit in a decoded layer redacts the literal that encloses it, so the code around it keeps its form.

The scan is linear in the length of a text: patterns start at marks and stop at the next one, and what concerns a line or
an identifier is found once for it, so a bundle of a single long line costs no more than the same text in short lines.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import spread

MASK = "[REDACTED]"

# -- formats that identify themselves; fixed values of their issuers
ISSUED = re.compile(
    r"""(?x)(?<![A-Za-z0-9_])(?:
      (?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])
    | gh[pousr]_[A-Za-z0-9]{30,}
    | github_pat_[A-Za-z0-9_]{40,}
    | glpat-[A-Za-z0-9_-]{18,}
    | xox[abeprs]-[A-Za-z0-9-]{16,}
    | sk-[A-Za-z0-9_-]{24,}
    | [sr]k_(?:live|test)_[A-Za-z0-9]{16,}
    | AIza[A-Za-z0-9_-]{35}
    | ya29\.[A-Za-z0-9_-]{20,}
    | npm_[A-Za-z0-9]{30,}
    | hf_[A-Za-z0-9]{30,}
    | shp(?:at|ss|ca)_[a-fA-F0-9]{32}
    | dop_v1_[a-f0-9]{64}
    | (?<!-)SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{30,}
    | pypi-[A-Za-z0-9_-]{40,}
    | AGE-SECRET-KEY-1[A-Z0-9]{50,}
    | (?<!-)eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{10,}
    )"""
)
PRIVATE_BLOCK = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN )[\s\S])*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)"
)
OPEN_BLOCK = re.compile(r"-----BEGIN (?!(?:[A-Z0-9]+ )*PRIVATE KEY)[A-Z0-9 ]+-----[\s\S]*?(?:-----END [A-Z0-9 ]+-----|\Z)")
URL_LOGIN = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]{1,24}://[^\s:/@\"'`<>]*:(?P<v>[^\s/@\"'`]+)@(?=[A-Za-z0-9\[.{$-])")
URL_PARAMETER = re.compile(
    r"(?i)[?&](?:access[_-]?token|auth[_-]?token|id[_-]?token|refresh[_-]?token|token|sig|signature|(?:api|access|account|subscription|shared)?[_-]?key|apikey|client[_-]?secret|secret|password|passwd|pwd|x-amz-signature)=(?P<v>[A-Za-z0-9%+/=._~-]{12,})"
)
WEBHOOK = re.compile(
    r"(?i)https?://hooks?\.[^\s\"'`/:]*(?::\d+)?(?:/[^\s\"'`/:]*)*?/(?:services|workflows|webhooks?)/(?P<v>[A-Za-z0-9]{6,}/[A-Za-z0-9]{6,}/[A-Za-z0-9]{16,})"
)
HEADER = re.compile(r"(?i)\b(?:bearer|token)\s+(?P<v>[A-Za-z0-9_.~+/=-]{20,})(?=[\"'`\s,;)]|$)")
BASIC = re.compile(r"(?i)\bbasic\s+(?P<v>[A-Za-z0-9+/]{10,}={0,2})(?![A-Za-z0-9+/=])")
CURL = re.compile(r"\bcurl\b")
CURL_USER = re.compile(r"\s(?:-u|--user)\s+[\"']?[^\s:\"'$]+:(?P<v>[^\s\"'$]{6,})")
NETRC = re.compile(r"\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<v>\S+)")
NPMRC = re.compile(r"(?i)_(?:authToken|auth|password)\s*=\s*[\"']?(?P<v>[^\s\"'$]{12,})")

# -- words and names before a value
STRONG = r"(?:pass(?:word|wd|phrase|code)?s?|pwd|pw|secrets?|tokens?|api[_-]?keys?|apikey|credentials?|auth(?:orization)?|(?:access|account|deploy|private|secret|signing|sign|encryption|master|client|service|shared|model|storage|license|session|admin|root|hmac|aes|rsa|ssh|subscription|registry|webhook|app|cipher)[_-]?keys?|bearer|cookie|private)"
#: Runs on the lower-cased text.
NAME = re.compile(
    rf"(?<![a-z0-9]){STRONG}(?:[_-]?(?:key|value|text|string|plain|raw|default|dev|prod|test|stage|old|new|\d{{1,2}}|base64|b64|hex))*(?![a-z0-9])"
)
CAMEL_NAME = re.compile(
    r"(?<=[a-z0-9])(?:Pass(?:word|wd|phrase)?|Pwd|Secret|Token|ApiKey|APIKey|Auth|(?:Access|Account|Deploy|Private|Secret|Signing|Encryption|Master|Client|Service|Shared)Key)(?:Value|Text|Raw)?(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:Secret|Shared|Account|Private|Signing)(?:Access)?Key(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:AccessKey|Password|Passphrase|Token|ApiKey|APIKey)(?![A-Za-z0-9])"
)
#: After the name: closing marks, a type, then a sign and a literal, possibly on the next line.
ASSIGNED = re.compile(
    r"""(?x)[\"'`\]\)]{0,3}\s{0,3}(?::\s*(?:str|string|String|Final(?:\[str\])?|const\ char\s*\*)\s*)?(?::=|=>|={1,3}|:|,)\s*(?:\n\s*)?(?:[rbuRBUfF]{0,2})(?P<q>\"\"\"|'''|[\"'`])"""
)
FALLBACK = re.compile(
    r"""(?x)(?:\|\||\?\?|\bor\b|(?:environ\.get|getenv|\.get|config|setting|env)\([ \t]*[\"'][^\"'\n]*[\"'][ \t]*,)[ \t]*(?:[rbu]?)(?P<q>[\"'`])"""
)
BARE = re.compile(r"""(?x)[\"']?\]?[ \t]{0,3}(?::=|=|:)[ \t]*(?P<v>[^\s\"'`<>(){}\[\],;]{6,}+)(?P<end>(?=[ \t]*(?:$|\#|;|,|\n)))?""", re.M)
SAID = re.compile(
    rf"(?i)\b(?:pass(?:word|phrase|code|wd)?|pwd|pw|secret|token|api key)\b(?:\s+(?:is|was|to|of|for \S+ is))?\s*[:=]?\s*(?P<w>[`\"'“]?)(?P<v>[^\s`\"'“”,;]{{8,}})"
)
LOGIN_CALL = re.compile(
    r"(?i)\b(?:log_?in|sign_?in|authenticate|auth|basic_?auth|set_credentials|credentials)\(\s*[\"'][^\"'\n]*[\"']\s*,\s*(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\n\\]){6,})(?P=q)"
)
IN_CREDS = re.compile(r"(?i)\b(?:creds?|credentials?)\b\s*(?::[^=\n]*)?[=:]\s*\{")
DICT_VALUE = re.compile(r"[\"']?[A-Za-z_][\w-]*[\"']?\s*:\s*(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\n\\]){6,})(?P=q)")

#: Names that mention a credential without holding one.
NOT_HOLDER = re.compile(
    r"(?i)(?:^|[_.\-a-z])(?:max|min|num|count|len|length)_?tokens?$|(?:type|name|names|field|fields|label|hint|policy|url|uri|path|file|dir|env|var|length|size|count|prefix|suffix|pattern|regex|rule|rules|message|error|column|header|param|form|input|reset|expiry|expires|ttl|limit|confirmation|id|ref|arn|store|provider|manager|service_name)$"
)
PLACEHOLDER = re.compile(
    r"""(?ix)^(?:
      [x*.•#_\-0]{3,} | [A-Z]{0,5}[Xx*]{6,} | .*(?:\*{3,}|x{6,}|\.{3}) .*
    | <.*>? | \$.* | \{.*\}? | %[\w(].* | \[.*\]? | .*\$\{.* | .*\{\{.* | .*<[a-z_ -]+>.*
    | .*(?:your[_-]|[_-]here$|replace[_-]?me|change[_-]?(?:me|this|it)|placeholder|redacted|insert[_-]|fill[_-]?in|not[_-]?(?:set|a[_-]?real)).*
    | (?:.*[^a-z])?(?:example|sample|dummy)(?:[^a-z].*)? | todo | tbd | fixme | fake
    | none | null | nil | undefined | true | false | (?:my[_-]?)?(?:password|passwd|secret|token|pass|key|apikey|credentials?)\d{0,3} | string | str | test(?:ing)? | foo | bar
    )$"""
)
WORDS = re.compile(r"[a-zäöüß]{3,}(?:[ -][a-zäöüß]{3,}){2,}")


def _der(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at an offset."""
    if len(data) < at + 2:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or len(data) < start + n:
            return None
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
    return (tag, start, start + size) if start + size <= len(data) else None


def _openssh(data: bytes) -> bool:
    """Whether bytes are an OpenSSH container: magic, cipher, derivation and its options, then public keys and the private part."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at = 15

    def field() -> bool:
        nonlocal at
        if len(data) < at + 4:
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or len(data) < at + 4:
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= keys <= len(data) and all(field() for _ in range(keys + 1))


#: Object identifiers of encryption with a password (PKCS#5) and of PKCS#7 contents, as DER; fixed values.
PKCS5, PKCS7 = b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x06\x09\x2a\x86\x48\x86\xf7\x0d\x01\x07"


def private_key_container(data: bytes) -> bool:
    """Whether bytes are a container of a private key: PKCS#1, PKCS#8 (also encrypted), PKCS#12, SEC 1, DSA or OpenSSH."""
    if _openssh(data) or data.lstrip().startswith(b"-----BEGIN") and b"PRIVATE KEY-----" in data[:64]:
        return True
    top = _der(data)
    if not top or top[0] != 0x30 or top[2] < len(data) - 2:
        return False
    kinds, at, values = [], top[1], []
    while at < top[2] and (e := _der(data, at)):
        kinds.append(e[0])
        values.append(data[e[1] : e[2]])
        at = e[2]
    if at != top[2]:
        return False
    if kinds[:1] == [0x02] and len(values[0]) == 1 and values[0][0] <= 1:
        if kinds[1:3] == [0x30, 0x04] or kinds[1:2] == [0x04]:
            return True  # PKCS#8, SEC 1
        return len(kinds) >= 6 and set(kinds) == {0x02}  # PKCS#1, DSA
    if kinds[:2] == [0x02, 0x30] and values[0] == b"\x03" and values[1].startswith(PKCS7):
        return True  # PKCS#12
    return kinds == [0x30, 0x04] and values[0][:1] == b"\x06" and PKCS5 in values[0]  # encrypted PKCS#8


#: Bits that a letter costs after another (rows and columns a to z) within words and identifiers: whole numbers, counted over
#: the 58,036 distinct camel-case parts of chunks and documents at scale 0.1 and of Python's standard library.
LETTER_BITS = """
84449555655444949444755555 36673788368477379567399868
38673784395578289564389979 37662788289678378656388989
65446555655444857344855555 37763589299688388566399978
38772875399676389557388988 28772898398778289675388988
65456545855443549544955555 28882888297798288879298888
37772777398787378767387989 38762888298588379866389959
36762889398668359856398979 38543638397677379743478989
75448555755443749344655555 38773786398588369465398969
55556556666555564545266565 38662779397656379545378869
38572885397678358753388879 38662785398677369456387968
74457555755444849444955555 28882888399888388888388898
28773787288786389667388898 38673687389788368875388678
38773888388676358766377988 28882888299889388888388988
""".split()
#: Bits of a word's first letter, and of a new word within an identifier.
FIRST_BITS, PART_BITS = 4.5, 4.0
#: Letters from which a literal without digits is judged, and bits by which chance must explain them better than words do:
#: of both cases, of one case.
MIN_LETTERS, MIXED_MARGIN, PLAIN_MARGIN = 8, 4.0, 16.0
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _random_letters(v: str) -> bool:
    """Whether the letters of a value come from chance rather than from words: a likelihood ratio of letter pairs and case."""
    letters = re.findall(r"[A-Za-z]", v)
    if len(letters) < MIN_LETTERS or not re.fullmatch(r"[A-Za-z0-9+/=_.~-]+", v):
        return False
    bits = 0.0
    for run in re.findall(r"[A-Za-z]+", v):
        for k, part in enumerate(_PART.findall(run)):
            low = part.lower()
            bits += FIRST_BITS + (PART_BITS if k else 0) + sum(int(LETTER_BITS[ord(a) - 97][ord(b) - 97]) for a, b in zip(low, low[1:]))
    mixed = any(c.islower() for c in letters) and any(c.isupper() for c in letters)
    return bits - len(letters) * math.log2(52 if mixed else 26) >= (MIXED_MARGIN if mixed else PLAIN_MARGIN)


#: Marks between letters that neither words, identifiers, paths, lists, addresses nor formats have there.
MARKED = re.compile(
    r"(?=.{8})(?=.*[A-Za-z][!#$%^&*+?~@]+[A-Za-z])(?![*#&+%?]|ctrl|alt|shift|cmd|meta)(?!.*(?:%[sdrif](?![a-z])|&[a-z]+;|\+(?:json|xml)|@[\w-]+\.\w|[*+?]$))[A-Za-z!#$%^&*+?~@_-]+",
    re.I,
)


def _random_like(v: str) -> bool:
    kinds = sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    return bool(re.search(r"\d", v)) and kinds >= 2 and len(v) >= 6 or _random_letters(v)


def _literal_like(v: str) -> bool:
    """The same of a quoted literal, where marks between letters tell too."""
    return _random_like(v) or bool(MARKED.fullmatch(v))


def _asks(name: str) -> tuple[bool, bool]:
    """What a name tells of its value: whether it may be words, whether it may be digits."""
    return bool(re.search(r"(?i)phrase", name)), bool(re.search(r"(?i)pass|pwd|pin|secret", name))


def _credible(v: str, name: str, quoted: bool) -> bool:
    """Whether a value after a credential's name is a working one by its form."""
    words, digits = _asks(name)
    if len(v) < 6 or PLACEHOLDER.match(v) or v.startswith(("http://", "https://", "/", "./", "@")) or re.search(r"\[REDACTED", v):
        return False
    if re.search(r"\s", v):
        return bool(words and (WORDS.fullmatch(v) or _random_like(v)) and len(v) >= 12)
    if re.fullmatch(r"[A-Za-z]+(?:[_./ -][A-Za-z]+)*", v):  # words, identifiers, paths, unless their letters are random
        return _random_letters(v) or bool(quoted and words and len(v) >= 16)
    return (_literal_like(v) if quoted else _random_like(v)) or bool(digits and re.fullmatch(r"\d{8,}", v))


_BASE64 = re.compile(r"[A-Za-z0-9+/\s]{16,}={0,2}\s*|[A-Za-z0-9_\-\s]{16,}={0,2}\s*")
_HEX = re.compile(r"(?:0x)?(?:[0-9a-fA-F]{2}){8,}")
_PERCENT = re.compile(r"%[0-9a-fA-F]{2}")
_ESCAPE = re.compile(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\([0-7]{3})")
#: Escapes of the escape's own sign: any number of such layers is one step.
_PERCENT_AGAIN = re.compile(r"%(?:25)+(?=[0-9a-fA-F]{2})")
_ESCAPE_AGAIN = re.compile(r"\\(?:x5[cC]|u005[cC]|134)+(?=x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-7]{3})")


def _decoded(text: str) -> Iterator[bytes]:
    """Next layers below a literal."""
    if _BASE64.fullmatch(text):
        flat = re.sub(r"\s", "", text).rstrip("=")
        try:
            yield base64.b64decode(flat.replace("-", "+").replace("_", "/") + "=" * (-len(flat) % 4))
        except (binascii.Error, ValueError):
            pass
    if _HEX.fullmatch(text):
        yield bytes.fromhex(text.removeprefix("0x"))
    if "%" in text and len(_PERCENT.findall(text)) >= 2:
        yield unquote(_PERCENT_AGAIN.sub("%", text)).encode()
    if "\\" in text and len(_ESCAPE.findall(text)) >= 2:
        raw = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16) if not m[3] else int(m[3], 8)), _ESCAPE_AGAIN.sub(r"\\", text))
        yield raw.encode("utf-8", "replace") if any(ord(c) > 255 for c in raw) else raw.encode("latin-1")


_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def _printable(data: bytes) -> str | None:
    try:
        t = data.decode()
    except UnicodeDecodeError:
        return None
    if len(t) < 6:
        return None
    if t.isascii():
        return t if len(_CONTROL.findall(t)) <= 0.05 * len(t) else None
    return t if sum(c.isprintable() or c in "\r\n\t" for c in t) >= 0.95 * len(t) else None


#: Literals and bare words that may hold a layer: long runs of an encoding's alphabet, or text with several escapes.
LITERAL = re.compile(r"(?<![A-Za-z0-9+/_=-])(?P<u>[A-Za-z0-9+/_-]{16,}+={0,2})(?![A-Za-z0-9+/_=-])")
ESCAPED_RUN = re.compile(r"(?:[^\s\"'`\\]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-7]{3}))++")
PERCENT_RUN = re.compile(r"(?:[A-Za-z0-9._~+:/-]|%[0-9a-fA-F]{2})++")
#: Encoded literals joined by a sign or by standing next to each other.
_PIECE = r"[\"'`](?:[A-Za-z0-9+/_=.:~-]|%|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-7]{3}))++[\"'`]"
CHAIN = re.compile(rf"{_PIECE}(?:\s*+(?:[+.\\]\s*+)?[rbuf]?{_PIECE})+")
IN_CHAIN = re.compile(_PIECE)
CUES = ("pass", "pw", "secret", "token", "key", "auth", "cred", "login", "sign", "basic", "bearer", "cookie", "private", "://", "curl", "machine")
#: What stands before an encoded value that is no credential.
_DIGEST_BEFORE = ("base64,", "sha256-", "sha384-", "sha512-", "sha256:")
_CLOSERS = {q: re.compile(rf"(?:[^{q}\\\n]|\\[^\n])*+{q}") for q in "\"'"}


def _close(text: str, at: int, q: str) -> int:
    """End of the literal whose text starts at an offset, -1 where it isn't closed."""
    if len(q) == 3 or q == "`":
        return text.find(q, at)
    m = _CLOSERS[q].match(text, at)
    return m.end() - 1 if m else -1


JOINED = re.compile(r"[\"'`]\s*(?:[+.\\]\s*|\n\s*)(?:[rbuf]?)(?P<q>[\"'`])")


def _pieces(text: str, at: int, q: str) -> tuple[str, list[tuple[int, int]]]:
    """A literal and those joined to it by `+` or by standing next to it: value and spans of the pieces."""
    values, spans = [], []
    while True:
        end = _close(text, at, q)
        if end < 0:
            break
        values.append(text[at:end])
        spans.append((at, end))
        m = JOINED.match(text, end) if len(q) == 1 else None
        if not m:
            break
        at, q = m.end(), m["q"]
    return "".join(values), spans


_IDENTIFIER = re.compile(r"[\w$.\-]+")
_COMMENT_START = re.compile(r"\s*(?:#|//|\*|--|;)")
_PROSE_START = re.compile(r"\s*(?:#|//|/\*|\*|--|<!--|\"\"\"|'{3})")
_SETTING_START = re.compile(r"\s*(?:export\s+)?[\w.-]*")
_TWO_WORDS = re.compile(r"(?:[^\n]*?[A-Za-z] ){2}")


class _Lines:
    """What concerns a line or an identifier of a text, found once for each."""

    def __init__(self, text: str):
        self.text = text
        self.ends = [m.start() for m in re.finditer("\n", text)]
        self._words: dict[int, int] = {}
        self._fallbacks: list[re.Match] | None = None
        self._identifiers: tuple[list[int], list[int]] | None = None

    def start(self, at: int) -> int:
        k = bisect_left(self.ends, at)
        return self.ends[k - 1] + 1 if k else 0

    def end(self, at: int) -> int:
        k = bisect_left(self.ends, at)
        return self.ends[k] if k < len(self.ends) else len(self.text)

    def words_before(self, at: int) -> bool:
        """Whether two words precede an offset in its line."""
        s = self.start(at)
        if s not in self._words:
            m = _TWO_WORDS.match(self.text, s)
            self._words[s] = m.end() if m else len(self.text) + 1
        return self._words[s] <= at

    def fallback(self, at: int) -> re.Match | None:
        """The first default value behind an offset, within its line."""
        if self._fallbacks is None:
            self._fallbacks = list(FALLBACK.finditer(self.text))
            self._fallback_at = [m.start() for m in self._fallbacks]
        k = bisect_left(self._fallback_at, at)
        return self._fallbacks[k] if k < len(self._fallbacks) and self._fallbacks[k].end() <= self.end(at) else None

    def last_names(self, names: Iterator[re.Match]) -> list[tuple[str, int]]:
        """Of the names in one identifier the last: (the identifier up to its end, end)."""
        if self._identifiers is None:
            self._identifiers = [m.start() for m in _IDENTIFIER.finditer(self.text)]
        last: dict[int, int] = {}
        for m in names:
            last[self._identifiers[bisect_right(self._identifiers, m.start()) - 1]] = m.end()
        return [(self.text[a:b], b) for a, b in last.items()]


def _layers(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Literals that may be encoded, and joined ones, with the spans of their pieces."""
    for m in LITERAL.finditer(text):
        yield m["u"], [m.span()]
    if "\\" in text:
        for m in ESCAPED_RUN.finditer(text):
            if len(_ESCAPE.findall(m[0])) >= 2:
                yield m[0], [m.span()]
    if "%" in text:
        for m in PERCENT_RUN.finditer(text):
            if len(_PERCENT.findall(m[0])) >= 2:
                yield m[0], [m.span()]
    for m in CHAIN.finditer(text):
        spans = [(x.start() + 1, x.end() - 1) for x in IN_CHAIN.finditer(text, m.start(), m.end())]
        yield "".join(text[a:b] for a, b in spans), spans


@lru_cache(maxsize=4096)
def _holds_secret(literal: str) -> bool:
    """Whether a layer below a literal is a key container or holds a credential, at any depth."""
    for data in _decoded(literal):
        t = _printable(data)
        if private_key_container(data) or t is not None and find_credentials(t):
            return True
    return False


def find_credentials(text: str) -> list[list[tuple[int, int]]]:
    """Each credential of a text as the spans of its pieces, in order, none overlapping."""
    hits: list[list[tuple[int, int]]] = []
    open_blocks = [m.span() for m in OPEN_BLOCK.finditer(text)] if "-----BEGIN" in text else []
    open_starts = [a for a, _ in open_blocks]

    def add(spans: list[tuple[int, int]]) -> None:
        a, b = spans[0][0], spans[-1][1]
        k = bisect_right(open_starts, a) - 1
        if b > a and not (k >= 0 and a < open_blocks[k][1]):
            hits.append(spans)

    if "PRIVATE KEY" in text:
        for m in PRIVATE_BLOCK.finditer(text):
            body = re.sub(r"-----[A-Z0-9 ]+-----|\\n|\s", "", m[0])
            if len(body) >= 16 and not PLACEHOLDER.match(body):
                add([m.span()])
    for m in ISSUED.finditer(text):
        if not re.search(r"X{6,}|EXAMPLE|0{12,}|1234567890", m[0]):
            add([m.span()])
    if "://" in text:
        for m in URL_LOGIN.finditer(text):
            if not PLACEHOLDER.match(m["v"]) and len(m["v"]) >= 4:
                add([m.span("v")])
        for p in (URL_PARAMETER, WEBHOOK):
            for m in p.finditer(text):
                if not PLACEHOLDER.match(m["v"]) and _random_like(m["v"]):
                    add([m.span("v")])
    low = text.lower()
    if len(low) != len(text):
        low = re.sub(r"[A-Z]+", lambda m: m[0].lower(), text)
    if any(c in low for c in CUES):
        _find_named(text, low, add)
    for literal, spans in _layers(text):
        a = spans[0][0]
        if not text[max(0, a - 24) : a].rstrip("\"'").endswith(_DIGEST_BEFORE) and _holds_secret(literal):
            add(spans)
    hits.sort(key=lambda s: (s[0][0], -s[-1][1]))
    out: list[list[tuple[int, int]]] = []
    for h in hits:
        if not out or h[0][0] >= out[-1][-1][1]:
            out.append(h)
    return out


def _find_named(text: str, low: str, add) -> None:
    """Credentials told by a name, a call or words before them."""
    lines = _Lines(text)
    if "curl" in low:
        curls = [m.start() for m in CURL.finditer(text)]
        for m in CURL_USER.finditer(text):
            k = bisect_right(curls, m.start()) - 1
            if k >= 0 and curls[k] >= lines.start(m.start()) and not PLACEHOLDER.match(m["v"]) and _random_like(m["v"]):
                add([m.span("v")])
    for p in (HEADER, NETRC, NPMRC, LOGIN_CALL):
        for m in p.finditer(text):
            if not PLACEHOLDER.match(m["v"]) and (_literal_like if p is LOGIN_CALL else _random_like)(m["v"]):
                add([m.span("v")])
    for m in BASIC.finditer(text):
        for data in _decoded(m["v"]) if len(m["v"]) >= 16 else ():
            t = _printable(data)
            if t and ":" in t and not PLACEHOLDER.match(t.split(":", 1)[1]):
                add([m.span("v")])
                break
    # a literal may be asked for by many names: its pieces are gathered once
    literals: dict[int, tuple[str, list[tuple[int, int]]]] = {}
    judged: dict[tuple[int, bool, bool], bool] = {}

    def literal(at: int, q: str, name: str) -> bool:
        if at not in literals:
            literals[at] = _pieces(text, at, q)
        value, spans = literals[at]
        key = (at, *_asks(name))
        if key not in judged:
            judged[key] = bool(spans) and _credible(value, name, True)
        if judged[key]:
            add(spans)
        return judged[key]

    bare_end = 0
    for whole, after in sorted([*lines.last_names(NAME.finditer(low)), *lines.last_names(CAMEL_NAME.finditer(text))], key=lambda n: n[1]):
        if NOT_HOLDER.search(whole):
            continue
        m = ASSIGNED.match(text, after)
        if m and literal(m.end(), m["q"], whole):
            continue
        fb = lines.fallback(after)
        if fb and literal(fb.end(), fb["q"], whole):
            continue
        b = BARE.match(text, after) if after >= bare_end else None  # a name inside a bare value is part of it
        if b:
            bare_end = b.end("v")
        if b and b["end"] is not None and _credible(b["v"], whole, False):
            v, first = b["v"], lines.start(after)
            in_code = re.fullmatch(r"[A-Za-z_$][A-Za-z_$.]*\d*", v) or re.search(r"[.]\w+$", v) and re.match(r"[a-z_]+\.", v)
            setting = "_" in v and not re.search(r"\s=\s", text[after : after + 3]) and _SETTING_START.fullmatch(text, first, after)
            if not in_code or _random_letters(v) or _COMMENT_START.match(text, first) or setting:
                add([b.span("v")])
    for m in SAID.finditer(text):
        prose = m["w"] == "`" or _PROSE_START.match(text, lines.start(m.start()), m.start()) or lines.words_before(m.start())
        v = m["v"].rstrip(".)")
        if prose and _random_like(v) and not PLACEHOLDER.match(v) and not re.fullmatch(r"[\w.]+\(.*", v) and not NOT_HOLDER.search(m[0].split()[0]):
            add([(m.start("v"), m.start("v") + len(v))])
    done = 0
    for m in IN_CREDS.finditer(text):
        end = text.find("}", m.end())
        end = end if end >= 0 else len(text)
        for v in DICT_VALUE.finditer(text, max(done, m.end()), end):
            if _literal_like(v["v"]) and not PLACEHOLDER.match(v["v"]):
                add([v.span("v")])
        done = max(done, end)


def redact(text: str, hits: list[list[tuple[int, int]]]) -> str:
    """The text with only the credentials replaced; the lines of a key block stay lines, so the line count holds."""
    out, at = [], 0
    for spans in hits:
        for k, (a, b) in enumerate(spans):
            out += [text[at:a], (MASK if k == 0 else "") + "\n" * text.count("\n", a, b)]
            at = b
    return "".join([*out, text[at:]])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines, texts = [], []
        for text in b.column(1).to_pylist():
            hits = find_credentials(text) if text else []
            ends = [m.start() for m in re.finditer("\n", text)] if hits else []
            lines.append(sorted({bisect_left(ends, h[0][0]) + 1 for h in hits}))
            texts.append(redact(text, hits) if hits else text)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(lines, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["id", "lines", "content"]
        )


def scan_chunks(chunks: DataFrame) -> DataFrame:
    """(id, lines, content): lines on which credentials begin, and the content with only the credentials replaced.

    Null and empty content has no credentials and stays as it is; repeated rows give repeated rows. Whole contents are
    scanned, of whatever length.
    """
    c = spread(chunks.select(F.col("id").cast("string").alias("id"), F.col("content").cast("string").alias("content")))
    return c.mapInArrow(_scan_batches, "id string, lines array<int>, content string")


def credential_lines(chunks: DataFrame) -> DataFrame:
    """(id, line_no): one row per distinct chunk id and line on which a credential begins."""
    return scan_chunks(chunks).select("id", F.explode("lines").alias("line_no")).distinct()


def redacted_chunks(chunks: DataFrame) -> DataFrame:
    """(id, has_secrets, n_lines, content): corrected flag and redacted content of every row; no content is shuffled."""
    return scan_chunks(chunks).select("id", (F.size("lines") > 0).alias("has_secrets"), F.size("lines").alias("n_lines"), "content")
