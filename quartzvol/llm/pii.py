"""Personal data in whole texts, also behind disguises, with spans in the source text.

Two passes over a text:
    1. Base patterns (email, ip, card, phone) on the text as it is, leftmost and
       without overlaps per kind; matches that fail their check are dropped.
    2. Where a text shows a disguise, transducers rewrite it: look-alike letters,
       full-width forms and other scripts' digits become ASCII, invisible
       characters vanish, spelled digits become digits (adjacent ones join up),
       and ``at`` / ``dot`` in brackets, or as words in one address, become @
       and a point; an address may mix these with plain ones, but a spoken at
       needs a disguised point. Every output character carries the source span it stands
       for, so what is detected in the rewritten text maps back. Such spans are
       added where no base span of their kind lies; base spans never change.

Spans count code points, end exclusive. Work per text is linear, one text at a time.

Defined results: null and empty texts have no spans; an empty table gives an empty
result; rows of null doc_id are reported with a null doc_id; equal rows give equal
rows; spans of one kind that tie in place don't occur, and spans of two kinds may
overlap. A very long text is read whole and costs memory in proportion to its
length; only doc_id and text are read, so no other column's name clashes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(rb"[0-9]")

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρτυι",
        "ABEKMHOPCTYXaeopcyxijsdqwhABEZHIKMNOPTYXaovptui",
        strict=True,
    )
)
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_INVISIBLE = "​‌‍⁠﻿­"
_OTHER_DIGITS = "".join(chr(c) for c in range(0x80, 0x20000) if unicodedata.decimal(chr(c), None) is not None)
_STRANGE = re.compile(f"[{_INVISIBLE}！-～{''.join(LOOKALIKES)}{_OTHER_DIGITS}]")
_WORD = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"\b(?:plus[\s-]+)?(?:{_WORD})(?:[\s-]+(?:{_WORD}))+\b|\b(?:{_WORD})\b(?=\s+dot\s)|(?<=\bdot\s)(?:{_WORD})\b", re.I)
#: Between words; a byte beyond ASCII may be part of a space.
_GAP = r"[\s\x1c-\x1f\x80-\xff-]"
_DIGIT_BYTES = tuple(w.encode() for w in DIGIT_WORDS)
_TWO_DIGITS = re.compile(rf"(?:{_WORD}){_GAP}+(?:{_WORD})(?![a-z0-9_])".encode())
_DOT_WORD = re.compile(rb"(?<![a-z0-9_])dot(?![a-z0-9_])")
_DIGIT_POINT = re.compile(rf"[0-9]{_GAP}+point{_GAP}+[0-9]".encode())
_AT_BRACKET = re.compile(rf"[\[({{<]{_GAP}*at{_GAP}*[\])}}>]".encode())
_ONE_WORD = re.compile(rf"plus|{_WORD}", re.I)
_BRACKETED = re.compile(r"(?:(?<!\s)\s++)?[\[({<]\s*(at|dot)\s*[\])}>]\s*", re.I)
#: A chain of words joined by spoken dots and, where an address goes on, its at and domain. Each chain is read once, so long ones stay linear.
_SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\s++dot\s++(?!at\s)[A-Za-z0-9._%+-]++)*+(?:(\s++at\s++|@)[A-Za-z0-9-]++((?:(?:\s++dot\s++|\.)[A-Za-z0-9-]++)++))?", re.I)
_SPOKEN_DOT = re.compile(r"(?<!\s)\s++dot\s++", re.I)
_DIGITS_DOT = re.compile(r"(?<=[0-9])\s+(?:dot|point)\s+(?=[0-9])", re.I)


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(match: bytes) -> bytes:
    return match.translate(None, b" ().+-")


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, stop) in bytes, by kind as listed, then start."""
    out = []
    end, at = 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        at = text.find(b"@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x) < 10 and int(x) <= 255 or not x.strip(b"0") or int(x.lstrip(b"0")[:4]) <= 255 and len(x.lstrip(b"0")) < 4 for x in m[0].split(b"."))]
    for m in _CARD.finditer(text):
        digits = _only_digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if b"+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0]).replace(b".", b"")) <= 15]
    return out


class Rewritten:
    """A text under rewriting: characters, and for each the source span it stands for."""

    def __init__(self, text: str):
        self.source = self.text = text
        self.start = list(range(len(text)))
        self.stop = list(range(1, len(text) + 1))

    def hidden(self, k: int) -> bool:
        """Whether the source had something else for this character."""
        return self.source[self.start[k] : self.stop[k]] != self.text[k]

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [a, b) by a string for each edit; edits are ordered and apart."""
        if not edits:
            return
        chars, start, stop, at = [], [], [], 0
        for a, b, new in edits:
            chars.append(self.text[at:a])
            start += self.start[at:a]
            stop += self.stop[at:a]
            if b > a:
                chars.append(new)
                start += [self.start[a]] * len(new)
                stop += [self.stop[b - 1]] * len(new)
            at = b
        chars.append(self.text[at:])
        self.start, self.stop, self.text = start + self.start[at:], stop + self.stop[at:], "".join(chars)


def _plain_character(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return LOOKALIKES.get(c) or str(unicodedata.decimal(c))


def rewrite(text: str) -> Rewritten | None:
    """The text without its disguises; None where nothing was disguised."""
    r = Rewritten(text)
    r.apply([(m.start(), m.end(), _plain_character(m[0])) for m in _STRANGE.finditer(r.text)])
    r.apply([(m.start(), m.end(), "@" if m[1].lower() == "at" else ".") for m in _BRACKETED.finditer(r.text)])
    edits = []
    for m in _SPOKEN.finditer(r.text):
        # A spoken at beside plain points is prose ("look at example.com").
        if m[1] is None or m[1] != "@" and not any(r.hidden(k) for k in range(*m.span(2)) if r.text[k] == ".") and not _SPOKEN_DOT.search(m[2]):
            continue
        edits += [(*d.span(), ".") for d in _SPOKEN_DOT.finditer(r.text, m.start(), m.start(1))]
        if m[1] != "@":
            edits.append((*m.span(1), "@"))
        edits += [(*d.span(), ".") for d in _SPOKEN_DOT.finditer(r.text, m.start(2), m.end())]
    r.apply(edits)
    edits = []
    for m in _SPELLED.finditer(r.text):
        at = m.start()
        for w in _ONE_WORD.finditer(r.text, m.start(), m.end()):
            if w.start() > at:
                edits.append((at, w.start(), ""))
            edits.append((*w.span(), DIGIT_WORDS.get(w[0].lower(), "+")))
            at = w.end()
    r.apply(edits)
    r.apply([(*m.span(), ".") for m in _DIGITS_DOT.finditer(r.text)])
    return None if r.text == text else r


def _disguised(raw: bytes) -> bool:
    """A cheap test that every text passes in which a transducer of words or brackets finds anything.

    Each transducer's pattern is tested on the source: the first one that
    changes a text has met its pattern there.
    """
    low = raw.lower()
    if b"dot" in low and _DOT_WORD.search(low):
        return True
    if b"point" in low and _DIGIT_POINT.search(low):
        return True
    if b"at" in low and _AT_BRACKET.search(low):
        return True
    return sum(low.count(w) for w in _DIGIT_BYTES) >= 2 and bool(_TWO_DIGITS.search(low))


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows, in code points of the source."""
    r = rewrite(text)
    if r is None:
        return []
    new = []
    raw = r.text.encode()
    for kind, a, b in base_spans(raw):
        a, b = len(raw[:a].decode()), len(raw[:b].decode())
        start, stop = r.start[a], r.stop[b - 1]
        if not any(k == kind and start < q and p < stop for k, p, q in base):
            new.append((kind, start, stop))
    return new


def may_be_strange(raw: np.ndarray) -> np.ndarray:
    """Bytes that begin a character beyond Latin-1, and soft hyphens: all that the look-alike transducer can change."""
    out = raw >= 0xC4
    out[1:] |= (raw[1:] == 0xAD) & (raw[:-1] == 0xC2)
    return out


def spans_of(raw: bytes, strange: bool = True) -> list[tuple[str, int, int, bool]]:
    """(kind, start, stop, added) of one UTF-8 text, in code points, by kind as listed, then start.

    ``strange`` says whether the text may hold characters that ``may_be_strange`` marks.
    """
    base = base_spans(raw)
    plain = raw.isascii()
    if base and not plain:
        place = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        base = [(k, int(place[a]), int(place[b])) for k, a, b in base]
    new = []
    if (strange and not plain and _STRANGE.search(raw.decode())) or _disguised(raw):
        new = added_spans(raw.decode(), base)
    rows = [(*s, False) for s in base] + [(*s, True) for s in new]
    return sorted(rows, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if new else rows


SPANS = "array<struct<kind:string,start:int,stop:int,added:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("added", pa.bool_())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
        raw, at = tokens.text_bytes(batch.column(1))
        odd = np.concatenate([[0], np.cumsum(may_be_strange(raw))])[at]
        found = [
            [dict(zip(("kind", "start", "stop", "added"), s, strict=True)) for s in spans_of(raw[at[i] : at[i + 1]].tobytes(), odd[i + 1] > odd[i])] for i in range(batch.num_rows)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_TYPE)], names=["doc_id", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, f"doc_id long, spans {SPANS}")


def redact(text: str, spans: list) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, end = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
        if s["start"] >= end:
            out += [text[end : s["start"]], f"[{s['kind'].upper()}]"]
        end = max(end, s["stop"])
    return "".join([*out, text[end:]])


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and the list of all spans, from ``find_personal_data``."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("spans", lambda s: ~s["added"])
    count = lambda kind: F.size(F.filter("spans", lambda s: ~s["added"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
