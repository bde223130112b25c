"""Personal data in texts, also where it is disguised.

Base spans come from the plain patterns over the text as it is. Then a chain of transducers
rewrites the text, and each rewriting carries two arrays along: for every code point it puts out,
where its source starts and ends. The chain:

1. characters: look-alikes of ASCII (full width, Cyrillic, Greek, mathematical), invisible ones dropped;
2. digit look-alikes (O, o, l, I, |) inside runs that are mostly digits;
3. spelled digits in a row (two and more), "plus" before and "dot" or "point" between digits;
4. "at" and "dot" in brackets, between underscores or hyphens, as entities, or as words between labels of
   an address, however many it has; a single "dot" also between numbers. "at" before a name with a real dot
   counts in capitals, after a local part with a dot or underscore between letters, or after a word like "mail".

The same patterns run over the result; a span found there goes back to source code points through
the arrays, and is added unless it lies within a base span of its kind: where an identifier is disguised
in part, its base span and the whole one are both given. A look-alike that stands alone (a column's "|",
the word "I") doesn't lengthen a base span. Time is in proportion to a text's length, however long it is.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship_by_value
from .common import id_and_text, plain_id

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: a match ends where its last digits end, so the first digit of a run is the only place to start
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters of other scripts that look like ASCII ones, and what they look like.
ALIKE_FROM = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁɡһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρι∕‐‑‒–—−․。٠۰〇"
ALIKE_TO = "ABESIJKMHOPCTYXaesijopcyxdghqwABEZHIKMNOPTYXovpi/------..000"
DROPPED = "­​‌‍‎‏⁠﻿"
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_NUMBER = "|".join(DIGITS)
_ALIKE = dict(zip(ALIKE_FROM, ALIKE_TO, strict=True))
_ODD = re.compile("[" + re.escape(ALIKE_FROM) + DROPPED + "  -  ①-⑨！-～\U0001d400-\U0001d7ff٠-٩۰-۹०-९]")
_TWO_DIGITS = re.compile(r"[0-9][ ().-]{0,2}[0-9]")
_DIGIT_RUN = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9OolI|](?:[ ().-]{0,2}[0-9OolI|]){6,}(?![A-Za-z0-9])")
#: two spelled digits of one row, whatever the row has between them; for lower-case text
_SPELLED_PAIR = re.compile(rf"\b(?:{_NUMBER})(?:[\s,\-]{{1,3}}(?:oh|plus|dot|point|[0-9]+))*[\s,\-]{{1,3}}(?:{_NUMBER})\b")
_SPELLED_ROW = re.compile(rf"\b(?:{_NUMBER}|oh|plus|dot|point)\b|[0-9]+", re.I)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT = re.compile(rf"(?:(?<!\s)\s+)?{_OPEN}\s*(?:at|arroba|@|a)\s*{_CLOSE}\s*|(?<=[A-Za-z0-9])\s*_at_\s*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])\s+@\s*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\s+(?=[A-Za-z0-9])", re.I)
_DOT = re.compile(rf"(?:(?<!\s)\s+)?{_OPEN}\s*(?:dot|punto|punkt|point|\.)\s*{_CLOSE}\s*|(?<=[A-Za-z0-9])\s*_dot_\s*(?=[A-Za-z0-9])", re.I)
_ENTITY = re.compile(r"&(?:#64|#x40|commat|#46|#x2e|period|#43|#x2b|plus);|(?<=[A-Za-z0-9])%40(?=[A-Za-z0-9-]+\.)", re.I)
_ENTITY_CHAR = {"#64": "@", "#x40": "@", "commat": "@", "#46": ".", "#x2e": ".", "period": ".", "#43": "+", "#x2b": "+", "plus": "+"}
_LOUD_AT = re.compile(r"(?<=[a-z0-9])\s+AT\s+(?=[A-Za-z0-9-]+\.[A-Za-z]{2,})")
_HYPHENED = re.compile(r"(?:(?<![A-Za-z0-9._%+-])|(?<=-)(?=[._%+][A-Za-z0-9._%+]))[A-Za-z0-9._%+]+(-at-)[A-Za-z0-9]+((?:-dot-[A-Za-z0-9]+)+)", re.I)
_SPACED_DOT = re.compile(r"(?<=[A-Za-z0-9])\s+\.\s+(?=[A-Za-z]{2,24}(?![A-Za-z0-9]))")
_LONE = re.compile(r"(?:^|(?<=\s))[OolI|](?=\s|$)")
#: the end of an address that needs no further label, and the countries under which such an end goes on (co.uk)
_FINISHED = re.compile(r"[a-z]{2}|com|net|org|edu|gov|mil|int|info|biz", re.I)
_SECOND_LEVEL = re.compile(r"\.?(?:com?|net|org|edu|gov|ac)\s+\.\s+(?:uk|au|nz|jp|br|za|kr|tr|cn|sg|hk|tw)(?![a-z0-9])", re.I)
_NUMBER_DOT = re.compile(r"(?<=[0-9])\s+(?:dot|point)\s+(?=[0-9])", re.I)
_DOT_AFTER = re.compile(r"\s+dot\s+(?=[A-Za-z0-9])", re.I)
_LABELS = re.compile(r"[A-Za-z0-9.-]+")
#: an address in words: local part, "at", label, ("dot" or "." label)+; the last label looks like a top domain
_WORD_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])(\s+at\s+)[A-Za-z0-9-]+((?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+)*)(\s+dot\s+|\.)[A-Za-z]{2,24}(?![A-Za-z0-9])", re.I)
_LOCAL_SHAPE = re.compile(r"[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*(?:[._][A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*)+")
# Words before an address.
CUES = frozenset("mail email e-mail contact address write reach".split())
_HINT = re.compile(rf"{_OPEN}\s*(?:at|arroba|@|a|dot|punto|punkt|point|\.)\s*{_CLOSE}|_at_|_dot_|\s@|@\s", re.I)
ship_by_value(__name__)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]+", "", s)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of EMAIL, looked for around each @ only."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The plain patterns, leftmost and non-overlapping for each kind; failing matches are dropped."""
    out = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and _luhn(d):
            out["card"].append(m.span())
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out["phone"].append(m.span())
    return out


class Rewritten:
    """A text with the source start and end of each of its code points."""

    def __init__(self, text: str):
        self.text = text
        self.start, self.end = np.arange(len(text)), np.arange(1, len(text) + 1)
        self.changed = False

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Put each ``(from, to, new)`` in place, in order and without overlaps; the new code points
        all stem from the whole of what they replace."""
        if not edits:
            return
        texts, starts, ends, done = [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[done:a], new]
            starts += [self.start[done:a], np.full(len(new), self.start[a])]
            ends += [self.end[done:a], np.full(len(new), self.end[b - 1])]
            done = b
        self.text = "".join([*texts, self.text[done:]])
        self.start = np.concatenate([*starts, self.start[done:]])
        self.end = np.concatenate([*ends, self.end[done:]])
        self.changed = True

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def _plain_character(c: str) -> str:
    if c in DROPPED:
        return ""
    if c in _ALIKE:
        return _ALIKE[c]
    if unicodedata.category(c) in ("Nd", "No"):
        return str(unicodedata.digit(c, c))
    n = unicodedata.normalize("NFKC", c)
    n = "".join(_ALIKE.get(x, x) for x in n)
    return n if n.isascii() and len(n) == 1 else c


def _characters(r: Rewritten) -> None:
    r.apply([(m.start(), m.end(), new) for m in _ODD.finditer(r.text) if (new := _plain_character(m.group())) != m.group()])


def _digit_lookalikes(r: Rewritten) -> None:
    if not _TWO_DIGITS.search(r.text):
        return
    edits = []
    for m in _DIGIT_RUN.finditer(r.text):
        s = m.group()
        odd = [i for i, c in enumerate(s) if c in "OolI|"]
        if odd and 3 * len(odd) <= len(_digits(s)):
            edits += [(m.start() + i, m.start() + i + 1, "0" if s[i] in "Oo" else "1") for i in odd]
    r.apply(edits)


def _spelled_digits(r: Rewritten) -> None:
    """Rows of spelled digits become digits without gaps; digits, "plus", "dot" may stand in the row."""
    text, low = r.text, r.text.lower()
    if sum(low.count(w) for w in DIGITS) < 2 or not _SPELLED_PAIR.search(low):
        return
    tokens = [(m.start(), m.end(), m.group().lower()) for m in _SPELLED_ROW.finditer(text)]
    rows, row = [], []
    for t in tokens:
        if row and not re.fullmatch(r"[\s,\-]{1,3}", text[row[-1][1]:t[0]]):
            rows.append(row)
            row = []
        row.append(t)
    rows.append(row)
    value = {w: str(i) for i, w in enumerate(DIGITS)} | {"oh": "0", "plus": "+", "dot": ".", "point": "."}
    edits = []
    for row in rows:
        while row and row[0][2] in ("dot", "point"):
            row = row[1:]
        while row and row[-1][2] in ("dot", "point", "plus"):
            row = row[:-1]
        if sum(w in DIGITS for _, _, w in row) < 2:
            continue
        lead = row[0][0]
        while lead > 0 and text[lead - 1] == " " and lead > row[0][0] - 3:
            lead -= 1
        first = lead if lead > 0 and text[lead - 1] == "+" else row[0][0]  # "+ four" as well as "+four"
        for i, (a, b, w) in enumerate(row):
            edits.append((row[i - 1][1] if i else first, b, value.get(w, w)))
    r.apply(edits)


def _word_start(text: str, at: int) -> int:
    """Where the word that ends at ``at`` starts."""
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return at


def _open_address(text: str, at: int) -> bool:
    """Whether the word that ends at ``at`` is an address that a dot between spaces may lengthen: one
    that ends like a complete address is followed by a full stop, unless a country comes after co or com."""
    start = _word_start(text, at)
    sign, dot = text.find("@", start, at), text.rfind(".", start, at)
    if sign < 0:
        return False
    return not (sign < dot and _FINISHED.fullmatch(text, dot + 1, at)) or bool(_SECOND_LEVEL.match(text, dot))


def _dot_before(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The word "dot" with the spaces around it that ends at ``at``, after a letter or digit."""
    b = at
    while b > least and text[b - 1].isspace():
        b -= 1
    a = b - 3
    if b == at or a <= least or text[a:b].lower() != "dot":
        return None
    while a > least and text[a - 1].isspace():
        a -= 1
    return (a, at) if a < b - 3 and a > least and text[a - 1] in LOCAL and text[a - 1].isalnum() else None


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in LOCAL:
        at -= 1
    return at


def _local_dots(text: str, at: int, least: int) -> tuple[int, list[tuple[int, int]]]:
    """For a local part that ends at ``at``: where its first label starts, and its "dot" words from left to right."""
    dots, start = [], _local_start(text, at, least)
    while start < at and (dot := _dot_before(text, start, least)):
        dots.append(dot)
        at, start = dot[0], _local_start(text, dot[0], least)
    return start, dots[::-1]


def _dots_at_signs(text: str) -> list[tuple[int, int, str]]:
    """"dot" words between the labels on both sides of each @."""
    edits, done, sign = [], 0, text.find("@")
    while sign >= 0:
        left = _local_dots(text, sign, done)[1] if _LABELS.match(text, sign + 1) else []
        edits += [(a, b, ".") for a, b in left]
        end = sign + 1
        while (m := _LABELS.match(text, end)) and (dot := _DOT_AFTER.match(text, m.end())) and m.group()[-1].isalnum():
            edits.append((*dot.span(), "."))
            end = dot.end()
        done = end
        sign = text.find("@", end)
    return edits


def _word_addresses(text: str) -> list[tuple[int, int, str]]:
    """Addresses with the word "at": with a "dot" among their labels, or with a local part that looks like one."""
    edits, done, m = [], 0, _WORD_AT.search(text)
    while m:
        start, dots = _local_dots(text, m.start(1), done)
        if start < m.start(1):
            right = [x.span() for x in re.finditer(r"\s+dot\s+", text[m.start(2):m.end(3)], re.I)]
            if dots or right or _LOCAL_SHAPE.fullmatch(text, start, m.start(1)) or _cued(text, start):
                edits += [(a, b, ".") for a, b in dots]
                edits.append((m.start(1), m.end(1), "@"))
                edits += [(a + m.start(2), b + m.start(2), ".") for a, b in right]
                done = m.end()
        m = _WORD_AT.search(text, max(done, m.end(1)))
    return edits


def _cued(text: str, at: int) -> bool:
    """Whether the word before ``at`` announces an address."""
    while at > 0 and (text[at - 1].isspace() or text[at - 1] in ":("):
        at -= 1
    return text[max(_word_start(text, at), at - 10):at].lower().lstrip("(") in CUES


def _at_and_dot(r: Rewritten) -> None:
    if "&" in r.text or "%40" in r.text:
        r.apply([(m.start(), m.end(), _ENTITY_CHAR.get(m.group().lower()[1:-1], "@")) for m in _ENTITY.finditer(r.text)])
    if any(c in r.text for c in "[({<@_") and _HINT.search(r.text):
        r.apply([(m.start(), m.end(), ".") for m in _DOT.finditer(r.text)])
        r.apply([(m.start(), m.end(), "@") for m in _AT.finditer(r.text)])
    if "@" in r.text:
        r.apply([(m.start(), m.end(), ".") for m in _SPACED_DOT.finditer(r.text) if _open_address(r.text, m.start())])
    if "AT" in r.text:
        r.apply([(m.start(), m.end(), "@") for m in _LOUD_AT.finditer(r.text)])
    low = r.text.lower()
    dots = "dot" in low
    if dots and "@" in r.text:
        r.apply(_dots_at_signs(r.text))
    if dots or "point" in low:
        r.apply([(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(r.text)])
    if dots and "-at-" in low:
        r.apply([e for m in _HYPHENED.finditer(r.text) for e in [(m.start(1), m.end(1), "@"), *(
            (m.start(2) + x.start(), m.start(2) + x.end(), ".") for x in re.finditer("-dot-", m.group(2), re.I))]])
    if "at" in low:
        r.apply(_word_addresses(r.text))
    if dots and "@" in r.text:
        r.apply(_dots_at_signs(r.text))


def normalise(text: str) -> Rewritten:
    r = Rewritten(text)
    if not text.isascii():
        _characters(r)
    _digit_lookalikes(r)
    _spelled_digits(r)
    _at_and_dot(r)
    return r


def _without_lone(text: str, a: int, b: int, own: list[tuple[int, int]], starts: list[int]) -> tuple[int, int]:
    """The span cut back to the base spans it overlaps, on a side where a look-alike stands alone beyond them."""
    i, j = bisect_right(starts, a), bisect_left(starts, b)  # own[i:j] start inside; the one before may reach in
    i -= i > 0 and own[i - 1][1] > a
    if i < j:
        first, last = own[i][0], own[j - 1][1]
        a = first if a < first and _LONE.search(text[a:first]) else a
        b = last if b > last and _LONE.search(text[last:b]) else b
    return a, b


def spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and all spans (base ones and those found in the rewritten text), by kind, in order."""
    base = base_spans(text)
    r = normalise(text)
    if not r.changed:
        return base, base
    found = {}
    for kind, hits in base_spans(r.text).items():
        own = base[kind]
        starts = [a for a, _ in own]
        added = []
        for a, b in sorted({_without_lone(text, *r.source(a, b), own, starts) for a, b in hits}):
            i = bisect_right(starts, a)
            within = i > 0 and own[i - 1][1] >= b
            if not within and (not added or a >= added[-1][1]):
                added.append((a, b))
        found[kind] = sorted(own + added)
    return base, found


def _written(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``(did, base, spans)`` for every row: ``kind:start:end`` lists, joined by commas. Offsets count
    code points, ends are exclusive. Null and empty texts have none; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), pa.array([_written(x) for x, _ in found], pa.string()), pa.array([_written(y) for _, y in found], pa.string())],
                ["did", "base", "spans"])

    return id_and_text(docs).mapInArrow(run, "did long, base string, spans string")


def masked(text: str | None) -> str | None:
    """The text with ``<KIND>`` in place of each span; of overlapping spans the one starting first
    stands for all. A text without personal data (or null) comes back as it is."""
    if not text:
        return text
    hits = sorted((a, -b, k) for k, s in spans(text)[1].items() for a, b in s)
    out, done, cut = [], 0, 0
    for a, b, kind in hits:
        if a >= done:
            out += [text[cut:a], f"<{kind.upper()}>"]
            done = cut = -b
        else:
            done = cut = max(done, -b)
    return "".join([*out, text[cut:]])


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with masked texts and, if there is such a column, ``n_chars`` counted anew; rows and
    all other columns stay as they are."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            texts = [masked(t) for t in b.column(i).to_pylist()]
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def op1_rows(docs: DataFrame) -> DataFrame:
    out = find_personal_data(docs)
    count = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(plain_id(F.col("did")).alias("doc_id"), *count, F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")
