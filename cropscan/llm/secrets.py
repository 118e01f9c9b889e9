"""Secrets in text: keyword automaton first, anchored patterns at its hits, then embedded checksums."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import ahocorasick
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import per_slice, texts

#: Kinds of the base patterns, then those that the method adds, in the order of equal starts.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("github", "npm", "stripe", "slack", "google", "jwt", "private_key", "bearer", "url_login")
KINDS = BASE_KINDS + ADDED_KINDS

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 32 or more is found at its first character, as the unbounded pattern finds it.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str, tail: str) -> bool:
    """The last six characters are the CRC-32 of those before them, in base 62."""
    value = zlib.crc32(body.encode())
    digits = ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = _BASE62[rest] + digits
    return digits == tail


def _github(m: re.Match) -> bool:
    return base62_crc(m[1][:-6], m[1][-6:])


def _jwt(m: re.Match) -> bool:
    """Header and payload are base64url of JSON objects, and the header names an algorithm."""
    try:
        head, load = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in m[0].split(".")[:2])
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head and isinstance(load, dict)


def _private_key(m: re.Match) -> bool:
    """The body is base64 of a DER sequence whose stated length fits what is there."""
    body = re.sub(r"\s+", "", m[2])
    try:
        raw = base64.b64decode(body, validate=True)
    except (binascii.Error, ValueError):
        return False
    if m[1].startswith("OPENSSH"):
        return raw.startswith(b"openssh-key-v1\0")
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    size = raw[1] & 0x7F
    return len(raw) == (2 + raw[1] if raw[1] < 0x80 else 2 + size + int.from_bytes(raw[2:2 + size], "big"))


def _always(m: re.Match) -> bool:
    return True


# Keyword in lower case, kind, pattern anchored at the keyword, check of what it matched.
PATTERNS = [
    *((k, "assign", _ASSIGN, lambda m: len(m[1]) >= 8)
      for k in ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("akia", "access", _ACCESS, lambda m: len(m[0]) >= 16),
    *((k, "github", re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _github)
      for k in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("npm_", "npm", re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _github),
    ("sk_live_", "stripe", re.compile(r"sk_live_[A-Za-z0-9]{24,}+"), _always),
    ("rk_live_", "stripe", re.compile(r"rk_live_[A-Za-z0-9]{24,}+"), _always),
    *((k, "slack", re.compile(r"xox[abprs]-[0-9]{8,}+-[A-Za-z0-9-]{16,}+"), _always)
      for k in ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    ("aiza", "google", re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), _always),
    ("eyj", "jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{6,}+\.eyJ[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]{16,}+"), _jwt),
    ("-----begin ", "private_key",
     re.compile(r"-----BEGIN ((?:RSA |EC |DSA |OPENSSH )?)PRIVATE KEY-----\s*+([A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----"),
     _private_key),
    ("bearer ", "bearer", re.compile(r"[Bb]earer [A-Za-z0-9+/_.=~-]{20,}+"), lambda m: bool(re.search("[0-9]", m[0]))),
    ("://", "url_login", re.compile(r"://[A-Za-z0-9._%+-]{1,64}:[^\s:@/\"'<>]{4,64}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"), _always),
]

_automaton = None


def automaton() -> ahocorasick.Automaton:
    """Built once in each worker from the fixed keywords."""
    global _automaton
    if _automaton is None:
        made = ahocorasick.Automaton()
        for i, (word, *_) in enumerate(PATTERNS):
            made.add_word(word, i)
        made.make_automaton()
        _automaton = made
    return _automaton


def secret_spans(text: str, lowered: str, has_hex: bool = True) -> list[tuple[str, int, int]]:
    """All spans by start, then kind; ``lowered`` is ``text`` with A-Z in lower case, of equal length."""
    out, ends = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - len(PATTERNS[i][0]), i) for end, i in automaton().iter(lowered))
    for start, i in hits:
        _, kind, pattern, holds = PATTERNS[i]
        if start < ends[kind]:
            continue
        if found := pattern.match(text, start):
            ends[kind] = found.end()
            if holds(found):
                out.append((kind, *found.span()))
    if has_hex:
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document, in no order.

    doc_id; n_assign, n_access, n_hex: base spans by kind; base_sha256: of the base spans; spans: those and the
    added kinds; n_added. Spans are kind:start:end in code points, end exclusive, by start, then
    kind as in KINDS. Null and empty text: zeros and an empty list. Repeated rows give repeated
    results; a null doc_id is kept. Hex runs have no keyword; they are scanned for directly, in
    texts that hold 32 such characters in a row.
    """

    def work(piece):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added")}
        column = piece["text"]
        has_hex = pc.match_substring_regex(column, "[0-9a-f]{32}").to_pylist()
        for text, lowered, runs in zip(column.to_pylist(), pc.ascii_lower(column).to_pylist(), has_hex, strict=True):
            spans = secret_spans(text, lowered, runs)
            base = [s for s in spans if s[0] in BASE_KINDS]
            for kind in BASE_KINDS:
                out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
            out["n_added"].append(len(spans) - len(base))
        return {"doc_id": piece["doc_id"], **out}

    return per_slice(
        texts(docs), work,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long",
    )
