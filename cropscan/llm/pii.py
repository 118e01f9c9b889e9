"""Personal data in text, also where it is disguised, with spans in the source text.

Plain identifiers are found by the base patterns. Disguised ones pass a cascade of transducers
(look-alike characters, spelled digits, at and dot disguises). Each transducer rewrites the text
and keeps, for every character it writes, the source range that it stands for, so that what the
base patterns find in the rewritten text is mapped back to source characters.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import per_slice, texts

KINDS = ("email", "ip", "card", "phone")

# --- base patterns ---------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits begins: what fails there fails from inside the run as well.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of plain identifiers, by kind and start."""
    out = [("email", *span) for span in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# --- rewriting with offsets ------------------------------------------------------------------


class Mapped:
    """A text with the source range [lo, hi) of each of its characters; None: its own."""

    def __init__(self, text: str, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        self.text, self.lo, self.hi = text, lo, hi

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace the ranges, in order and without overlap; a longer replacement shares its range."""
        if not edits:
            return self
        lo = np.arange(len(self.text)) if self.lo is None else self.lo
        hi = np.arange(1, len(self.text) + 1) if self.hi is None else self.hi
        parts, los, his, at = [], [], [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            los += [lo[at:start], np.full(len(new), lo[start])]
            his += [hi[at:start], np.full(len(new), hi[end - 1])]
            at = end
        return Mapped("".join(parts) + self.text[at:], np.concatenate([*los, lo[at:]]), np.concatenate([*his, hi[at:]]))


# Letters of other alphabets that look like ASCII ones.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ℓ": "l", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "｡": ".",
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ",
}
# Characters without width.
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"

_FOREIGN = re.compile(r"[^\x00-\x7f]")
_ASCII_WORD = re.compile(r"[A-Za-z0-9@.+\- ]")
_folds: dict[str, str | None] = {}


def _fold(char: str) -> str | None:
    """What a non-ASCII character looks like in ASCII; None if it is itself."""
    if char in _folds:
        return _folds[char]
    if char in INVISIBLE:
        new = ""
    else:
        new = LOOKALIKES.get(char)
        if new is None and (digit := unicodedata.digit(char, None)) is not None:
            new = str(digit)
        if new is None:
            flat = unicodedata.normalize("NFKC", char)
            new = flat if len(flat) == 1 and _ASCII_WORD.match(flat) else LOOKALIKES.get(flat)
    if len(_folds) < 100_000:
        _folds[char] = new
    return new


def fold_lookalikes(m: Mapped) -> Mapped:
    if m.text.isascii():
        return m
    foreign = {c: new for c in set(_FOREIGN.findall(m.text)) if (new := _fold(c)) is not None}
    if not foreign:
        return m
    pattern = re.compile("[" + re.escape("".join(foreign)) + "]")
    return m.rewrite([(x.start(), x.end(), foreign[x[0]]) for x in pattern.finditer(m.text)])


# Digits spelled in the languages read here, and the words that stand for signs.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
SIGN_WORDS = {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-"}
TIMES = {"double": 2, "triple": 3}

_SPELLED = "|".join(sorted({*DIGIT_WORDS, *SIGN_WORDS, *TIMES}, key=len, reverse=True))
_SPELLED_ONE = re.compile(rf"(?i)(?<!\w)(?:{_SPELLED})(?!\w)")
_SPELLED_TOKEN = re.compile(rf"(?i)(?:(?P<word>(?:{_SPELLED}))(?!\w)|(?P<figures>[0-9]+)(?!\w)|(?P<sign>[+.]))")
_SPELLED_GAP = re.compile(r"[ \t\r\n,;/-]*+")
#: Fewer spelled digits than these in a row are prose, whatever they add up to.
SPELLED_LEAST = 4


def read_spelled(m: Mapped) -> Mapped:
    """Runs of digit words become digits; a run has SPELLED_LEAST words and eight digits or more."""
    text, edits, at = m.text, [], 0
    while first := _SPELLED_ONE.search(text, at):
        start, place, run, words, digits, times = first.start(), first.start(), [], 0, 0, 1
        end = start
        while token := _SPELLED_TOKEN.match(text, place):
            word = (token["word"] or "").lower()
            if word in TIMES:
                times = TIMES[word]
                run.append((token.start(), token.end(), ""))
            else:
                new = DIGIT_WORDS.get(word) or SIGN_WORDS.get(word) or token[0]
                if new.isdigit():
                    digits += len(new) * times
                    words += bool(word)
                run.append((token.start(), token.end(), new * (times if new.isdigit() else 1)))
                times = 1
            end = token.end()
            place = _SPELLED_GAP.match(text, end).end()
            if place == end and not text[end - 1] in "+.":
                nxt = text[end:end + 1]
                if nxt not in "+." or not nxt:
                    break
        at = max(end, first.end())
        if words >= SPELLED_LEAST and digits >= 4 and (digits >= 8 or sum(x[2] == "." for x in run) >= 3):
            while run and run[-1][2] in ("", ".", "+", "-"):
                run.pop()
            for i, (a, b, new) in enumerate(run):
                if new != text[a:b]:
                    edits.append((a, b, new))
                if i + 1 < len(run) and b < run[i + 1][0]:
                    edits.append((b, run[i + 1][0], ""))
    return m.rewrite(edits)


_AT_WORDS, _DOT_WORDS = "at|arroba|ät|chez|@", r"dot|punto|punkt|point|\."
# A run of blanks is entered at its first one only: a failed run of any length is read once.
_BLANKS = r"(?<![ \t])[ \t]++"
_OPEN, _CLOSE = rf"(?:{_BLANKS})?+[\[({{<|_*~-]{{1,2}}[ \t]*+", r"[ \t]*+[\])}>|_*~-]{1,2}[ \t]*+"
_MARKED_AT = rf"{_OPEN}(?:{_AT_WORDS}){_CLOSE}"
_MARKED_DOT = rf"{_OPEN}(?:{_DOT_WORDS}){_CLOSE}"
_CODED_AT, _CODED_DOT = r"&#0*64;|&#x0*40;|&commat;|%40", r"&#0*46;|&#x0*2e;|&period;|%2e"
_BARE_AT, _BARE_DOT = rf"{_BLANKS}(?:at|arroba)[ \t]++", rf"{_BLANKS}(?:dot|punto|punkt|point)[ \t]++"
_SPACED_AT, _SPACED_DOT = rf"{_BLANKS}@[ \t]*+|@[ \t]++", rf"{_BLANKS}\.[ \t]++"
_ANY_AT = re.compile(rf"(?i){_MARKED_AT}|{_CODED_AT}|{_BARE_AT}|{_SPACED_AT}|@")
_ANY_DOT = re.compile(rf"(?i){_MARKED_DOT}|{_CODED_DOT}|{_BARE_DOT}|{_SPACED_DOT}|\.")
_STRONG_AT = re.compile(rf"(?i){_MARKED_AT}|{_CODED_AT}")
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_NAME_END = re.compile(r"[A-Za-z0-9_%+-]+\Z")
_DOT_END = re.compile(rf"(?i)(?:{_MARKED_DOT}|{_CODED_DOT}|{_BARE_DOT}|{_SPACED_DOT}|\.)\Z")
_HINTS = re.compile(r"(?i)[\[({<|_*~-][ \t]*(?:at|arroba|ät|chez|@|dot|punto|punkt|point|\.)[ \t]*[\])}>|_*~-]"
                    r"|&(?:#0*64|#x0*40|commat|#0*46|#x0*2e|period);|%40|%2e|[ \t](?:dot|punto|punkt|point)[ \t]|[ \t]@|@[ \t]"
                    r"|[a-z0-9-][ \t]+\.[ \t]+[a-z0-9-]")
_FIGURE_DOT = re.compile(rf"(?i)(?<=[0-9])(?:{_MARKED_DOT}|{_CODED_DOT}|{_BARE_DOT}|{_SPACED_DOT})(?=[0-9])")
#: Code points looked at before an at sign for the name; longer names are not disguised by hand.
NAME_REACH = 128


def read_at_and_dot(m: Mapped) -> Mapped:
    """Disguised at and dot signs between a name and a domain, and dots between figures.

    A bare word "at" counts only if the domain has a disguised dot as well.
    """
    text, edits = m.text, []
    if not _HINTS.search(text):
        return m
    done = 0
    for at in _ANY_AT.finditer(text):
        if at.start() < done:
            continue
        label = _LABEL.match(text, at.end())
        if not label:
            continue
        dots, end = [], label.end()
        while (dot := _ANY_DOT.match(text, end)) and (label := _LABEL.match(text, dot.end())):
            dots.append(dot)
            end = label.end()
        hidden = [d for d in dots if d[0] != "."]
        strong = _STRONG_AT.fullmatch(at[0])
        if not dots or not (hidden or strong or at[0] != "@" and "@" in at[0]):
            continue
        if not strong and "@" not in at[0] and not hidden:
            continue
        head, names = text[max(done, at.start() - NAME_REACH):at.start()], []
        base = at.start() - len(head)
        if not _NAME_END.search(head):
            continue
        while name := _NAME_END.search(head):
            head = head[:name.start()]
            dot = _DOT_END.search(head)
            if not dot or not _NAME_END.search(head[:dot.start()]):
                break
            if dot[0] != ".":
                names.append((base + dot.start(), base + dot.end(), "."))
            head = head[:dot.start()]
        new = [*reversed(names), *([] if at[0] == "@" else [(at.start(), at.end(), "@")]),
               *((d.start(), d.end(), ".") for d in hidden)]
        edits += new
        done = end
    # Edits so far do not overlap: of those that begin before a dot ends, the last one reaches furthest.
    taken = sorted((a, b) for a, b, _ in edits)
    for dot in _FIGURE_DOT.finditer(text):
        before = bisect.bisect_left(taken, (dot.end(),)) - 1
        if before < 0 or taken[before][1] <= dot.start():
            edits.append((dot.start(), dot.end(), "."))
    return m.rewrite(sorted(edits))


_MIXED_RUN = re.compile(r"(?<![A-Za-z0-9])\+?\(?(?:[0-9OoQlI|SB]++[ ().-]{0,2}+)++")
_MIXED_TAIL = re.compile(r"[A-Za-z0-9]")
_MIXED_PART = re.compile(r"[0-9OoQlI|SB]+")
_AS_DIGIT = {"O": "0", "o": "0", "Q": "0", "l": "1", "I": "1", "|": "1", "S": "5", "B": "8"}
_CARD_GAPS = re.compile(r"(?<![0-9])[0-9]{4}(?:([ ._/*-]{1,3})[0-9]{4}){3}(?![0-9])")


def _run_end(text: str, run: re.Match) -> int:
    """Where the run ends; before its last sign if another letter or digit follows the run."""
    end = run.end()
    if _MIXED_TAIL.match(text, end):
        while end > run.start() and _MIXED_TAIL.match(text, end):
            end -= 1
    return end


def read_figures(m: Mapped) -> Mapped:
    """Letters among digits that stand for digits, and unusual gaps between the parts of a card number."""
    edits = []
    for run in _MIXED_RUN.finditer(m.text):
        for part in _MIXED_PART.finditer(m.text, run.start(), _run_end(m.text, run)):
            letters = [i for i, c in enumerate(part[0]) if c in _AS_DIGIT]
            if letters and len(part[0]) > len(letters):
                edits += [(part.start() + i, part.start() + i + 1, _AS_DIGIT[part[0][i]]) for i in letters]
    m = m.rewrite(edits)
    gaps = []
    for run in _CARD_GAPS.finditer(m.text):
        gaps += [(run.start() + g.start(), run.start() + g.end(), "-")
                 for g in re.finditer(r"[^0-9]+", run[0]) if g[0] not in ("-", " ")]
    return m.rewrite(gaps)


# Every text that a transducer would change matches one of these; they only save time.
SUSPECTS = (
    r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]",
    rf"(?i)(?:^|[^\pL\pN_])(?:{_SPELLED})[ \t\r\n,;/+.-]+(?:{_SPELLED}|[0-9])",
    rf"(?i){_HINTS.pattern.removeprefix('(?i)')}",
    r"(?i)(?:\[\.\]|[0-9]{4}[ ._/*-]{1,3}[0-9]{4})",
    r"[0-9][OoQlI|SB]|[OoQlI|SB][0-9]",
)

TRANSDUCERS = (fold_lookalikes, read_spelled, read_at_and_dot, read_figures)


def disguised_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Source spans that only the rewritten text shows, none inside a base span of its kind."""
    m = Mapped(text)
    for transducer in TRANSDUCERS:
        m = transducer(m)
    if m.lo is None:
        return []
    known = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    changed = np.concatenate([[0], np.cumsum((m.hi - m.lo != 1) | _differs(text, m))])
    out = []
    for kind, start, end in base_spans(m.text):
        lo, hi = int(m.lo[start]), int(m.hi[end - 1])
        rewritten = changed[end] > changed[start] or hi - lo != end - start
        # Base spans of a kind do not overlap: only the last that begins here or before can hold this one.
        before = bisect.bisect_right(known[kind], (lo, len(text) + 1)) - 1
        if rewritten and (before < 0 or known[kind][before][1] < hi):
            out.append((kind, lo, hi))
    return out


def _differs(text: str, m: Mapped) -> np.ndarray:
    source = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.frombuffer(m.text.encode("utf-32-le", "surrogatepass"), np.uint32) != source[m.lo]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(column: pa.Array) -> dict[str, list]:
    """The result columns for texts without nulls."""
    out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised")}
    suspect = functools.reduce(pc.or_, (pc.match_substring_regex(column, p) for p in SUSPECTS)).to_pylist()
    for text, doubtful in zip(column.to_pylist(), suspect, strict=True):
        base = base_spans(text)
        added = disguised_spans(text, base) if doubtful else []
        for kind in KINDS:
            out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
        out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out["spans"].append(joined(sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), *s[1:]))))
        out["n_disguised"].append(len(added))
    return out


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document, in no order.

    doc_id; n_email, n_ip, n_card, n_phone: base spans by kind; base_sha256: of the base spans;
    spans: base and disguised ones; n_disguised: how many were added. Spans are kind:start:end in code points,
    end exclusive, by kind as in KINDS, then start. Null and empty text: zeros and an empty list.
    Repeated rows give repeated results; a null doc_id is kept.
    """

    def work(piece):
        return {"doc_id": piece["doc_id"], **found(piece["text"])}

    return per_slice(
        texts(docs), work,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long",
    )
