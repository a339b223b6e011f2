"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, schemes, digits, plus signs before a digit, and cue
words of identifiers. At an anchor a parser of its kind expands to the left and right until a character that cannot
belong, and validates what stands there. A parser never reads back over what its kind has consumed and never tries
again inside it, so every kind's spans are leftmost and apart, and the work is linear in the text.

Kinds, in the order of reports. The first four are fixed patterns (see README), the others are the method's own:

- email, from an at-sign: local part to the left, dotted labels to the right
- ip, from a digit: four dotted numbers up to 255
- card, from a digit: digits with single spaces or hyphens, 16 to 19 of them, passing Luhn
- phone, from a plus sign with a digit: 8 to 15 digits
- url, from `://`: a scheme to the left, a host with a dot (or localhost) and the rest to the right
- iban, from its cue: country, check digits and up to 30 more characters, remainder 1 modulo 97
- account, from cues such as `account number`: 6 to 18 digits
- ssn, from its cues: three groups of digits, none of them a value that is never given out
- key, from prefixes of access keys

Offsets are code points. Spans of different kinds may overlap; redaction replaces what any of them covers.

Edge cases: a null text is empty; a text of any length is searched whole; repeated rows are searched alike; where two
spans of one kind could begin at one place there is one; columns of docs that bear a result's name are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegauge.llm.common import appended, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "ssn", "key")

#: A parser takes (text, anchor, floor) and gives (consumed up to, start, end) with start < 0 where nothing stands.
Parser = Callable[[str, int, int], tuple[int, int, int]]

_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_SCHEME = _ALNUM | frozenset("+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])++")
_DIALLED = re.compile(r"[ ().0-9-]*+")
_REST = re.compile(r"""[^\s<>"'`{}|\\^]*+""")
_HOST = re.compile(r"[A-Za-z0-9.-]*+")
_LEAD = re.compile(r"[ .:#=]{0,4}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,17}+(?![ -]?[0-9]|[A-Za-z])")
_SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_KEYS = (("akia", re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")), ("ghp_", re.compile(r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])")), ("sk_live_", re.compile(r"sk_live_[0-9A-Za-z]{24,99}+")), ("xoxb-", re.compile(r"xoxb-[0-9A-Za-z-]{20,99}+")))
_NOTHING = -1, -1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int, int]:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at or not (m := _DOMAIN.match(text, at + 1)):
        return at + 1, *_NOTHING
    return m.end(), start, m.end()


def _ip(text: str, at: int, floor: int) -> tuple[int, int, int]:
    m = _DOTTED.match(text, at)
    if not m:  # no later digit of this number can begin one either
        return _DIGITS.match(text, at).end(), *_NOTHING
    parts = [p.lstrip("0") for p in m.group().split(".")]
    fits = all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts)
    return m.end(), *(m.span() if fits else _NOTHING)


def _card(text: str, at: int, floor: int) -> tuple[int, int, int]:
    m = _GROUPED.match(text, at)
    if not m:
        return at + 1, *_NOTHING
    digits = m.group().replace(" ", "").replace("-", "")
    return m.end(), *(m.span() if 16 <= len(digits) <= 19 and luhn(digits) else _NOTHING)


def _phone(text: str, at: int, floor: int) -> tuple[int, int, int]:
    inside = _DIALLED.match(text, at + 2).group().rstrip(" ().-")
    end = at + 2 + len(inside)
    if len(inside) < 2:
        return at + 2, *_NOTHING
    n = 1 + sum(map(str.isdigit, inside))
    return end, *((at, end) if 8 <= n <= 15 else _NOTHING)


def _url(text: str, at: int, floor: int) -> tuple[int, int, int]:
    start = at
    while start > floor and text[start - 1] in _SCHEME:
        start -= 1
    while start < at and not ("A" <= text[start] <= "Z" or "a" <= text[start] <= "z"):
        start += 1
    host = _HOST.match(text, at + 3).group().strip(".-").lower()
    if start == at or not (host == "localhost" or "." in host and ".." not in host):
        return at + 3, *_NOTHING
    end = at + 3 + len(_REST.match(text, at + 3).group().rstrip(".,;:!?)]"))
    return end, start, end


def _iban(text: str, at: int, floor: int) -> tuple[int, int, int]:
    start = _LEAD.match(text, at).end()
    m = _IBAN.match(text, start)
    if not m:
        return at, *_NOTHING
    end = m.end()
    while end - start > 14:  # the longest beginning that is valid and ends at a boundary
        code = text[start:end].replace(" ", "")
        whole = end == len(text) or text[end] not in _ALNUM
        if whole and 15 <= len(code) <= 34 and text[end - 1] != " " and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end, start, end
        end -= 1
    return at, *_NOTHING


def _account(text: str, at: int, floor: int) -> tuple[int, int, int]:
    m = _ACCOUNT.match(text, _LEAD.match(text, at).end())
    return (m.end(), *m.span()) if m else (at, *_NOTHING)


def _ssn(text: str, at: int, floor: int) -> tuple[int, int, int]:
    m = _SSN.match(text, _LEAD.match(text, at).end())
    if not m or m[1] in ("000", "666") or m[1] >= "900" or m[2] == "00" or m[3] == "0000":
        return at, *_NOTHING
    return m.end(), *m.span()


def _key(pattern: re.Pattern) -> Parser:
    def parse(text: str, at: int, floor: int) -> tuple[int, int, int]:
        m = pattern.match(text, at) if not at or text[at - 1] not in _ALNUM else None
        return (m.end(), *m.span()) if m else (at + 1, *_NOTHING)

    return parse


#: Cue words, lower-case; what they announce begins after them.
CUES: dict[str, Parser] = {"iban": _iban, "account": _account, "ssn": _ssn}
CUE_WORDS = {"iban": ("iban",), "account": ("account number", "account no", "account", "acct", "kontonummer", "numéro de compte", "número de cuenta"), "ssn": ("ssn", "social security number", "social security no")}


class Finder:
    """Anchors of all kinds in one automaton, and the parser of each."""

    def __init__(self) -> None:
        import ahocorasick

        anchors: dict[str, list[tuple[int, int, Parser]]] = {}

        def add(word: str, kind: str, parse: Parser, ahead: int) -> None:
            anchors.setdefault(word, []).append((KINDS.index(kind), ahead, parse))

        add("@", "email", _email, 0)
        add("://", "url", _url, 0)
        for d in "0123456789":
            add(d, "ip", _ip, 0)
            add(d, "card", _card, 0)
            add("+" + d, "phone", _phone, 0)
        for kind, words in CUE_WORDS.items():
            for word in words:
                add(word, kind, CUES[kind], len(word))
        for word, pattern in _KEYS:
            add(word, "key", _key(pattern), 0)
        self.automaton = ahocorasick.Automaton()
        for word, parsers in anchors.items():
            self.automaton.add_word(word, (len(word), parsers))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(kind number, start, end), by kind and start. Cues are matched in the text with A-Z lower-cased."""
        found, consumed = [], [0] * len(KINDS)
        lowered = text.lower() if text.isascii() else text.encode().lower().decode()
        for last, (size, parsers) in self.automaton.iter(lowered):
            for kind, ahead, parse in parsers:
                at = last - size + 1 + ahead
                if at >= consumed[kind]:
                    consumed[kind], start, end = parse(text, at, consumed[kind])
                    if start >= 0:
                        found.append((kind, start, end))
        found.sort()
        return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a mark such as <email> for each stretch that spans cover, named after its first span."""
    out, last = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= last:
            out += [text[last:a], f"<{KINDS[k]}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


FOUND = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
RESULT = T.StructType().add("n_email", "long").add("n_ip", "long").add("n_card", "long").add("n_phone", "long").add("base_sha256", "string").add("spans", "string").add("found", FOUND).add("redacted", "string")
_finder: list[Finder] = []


def _make(column: str, outputs: list[T.StructField]) -> Callable[[pa.RecordBatch], list[pa.Array]]:
    names = [f.name for f in outputs]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if not _finder:
            _finder.append(Finder())
        texts = [t.decode() for t in texts_of(batch.column(column))]
        rows = [_finder[0].find(t) for t in texts]
        counts = [[sum(s[0] == k for s in spans) for spans in rows] for k in range(len(BASE_KINDS))]
        base = [hashlib.sha256(listed([s for s in spans if s[0] < len(BASE_KINDS)]).encode()).hexdigest() for spans in rows]
        every = dict(zip(("n_email", "n_ip", "n_card", "n_phone"), (pa.array(c, pa.int64()) for c in counts)))
        every |= {"base_sha256": pa.array(base, pa.string()), "spans": pa.array(map(listed, rows), pa.string())}
        if "found" in names:
            every["found"] = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans] for spans in rows], span)
        if "redacted" in names:
            every["redacted"] = pa.array(map(redacted, texts, rows), pa.string())
        return [every[n] for n in names]

    return make


def find_pii(docs: DataFrame, text: str = "text", outputs: tuple[str, ...] = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found", "redacted")) -> DataFrame:
    """docs with the named columns of RESULT; columns of the same names are replaced."""
    fields = [RESULT[n] for n in outputs]
    return appended(docs, fields, _make(text, fields), text)
