import base64
import json
import random
import re
import zlib

import pyarrow as pa
import pyarrow.compute as pc

from cropscan.llm import secrets
from helpers import EDGES, by_id, make

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def spans(text):
    return secrets.secret_spans(text, pc.ascii_lower(pa.array([text]))[0].as_py())


def test_base_spans_equal_the_plain_patterns():
    random.seed(4)
    parts = ["token", "Secret", "=", ":", " ", '"', "abcd1234", "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef",
             "api_key", "apikey", "PASSWORD", "é", "İ", "ſecret"]
    for _ in range(20_000):
        text = "".join(random.choices(parts, k=random.randint(0, 14)))
        assert [s for s in spans(text) if s[0] in secrets.BASE_KINDS] == plain(text), text


def github(body):
    value, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        tail = secrets._BASE62[rest] + tail
    return f"ghp_{body}{tail}"


def test_checksums_decide():
    good = github("a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5")
    assert ("github", 5, 5 + len(good)) in spans(f"key: {good} end")
    wrong = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert not [s for s in spans(wrong) if s[0] == "github"]


def test_structures_decide():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{part({'alg': 'HS256'})}.{part({'sub': '12345'})}.{'s' * 43}"
    assert [s[0] for s in spans(f"x {jwt} y")] == ["jwt"]
    assert not [s for s in spans(jwt.replace("eyJ", "eyK", 1)) if s[0] == "jwt"]
    body = base64.b64encode(bytes([0x30, 4, 1, 2, 3, 4])).decode()
    assert [s[0] for s in spans(f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----")] == ["private_key"]
    broken = base64.b64encode(bytes([0x30, 9, 1, 2, 3, 4])).decode()
    assert not spans(f"-----BEGIN PRIVATE KEY-----\n{broken}\n-----END PRIVATE KEY-----")


def test_long_runs_take_linear_time():
    for text in ("token " * 50_000, "a" * 400_000, "AKIA" * 50_000, "token=" * 50_000, "eyJ" * 50_000, "://a:" * 40_000):
        secrets.secret_spans(text, text.lower())


def test_rows_and_edges(spark):
    rows = [*EDGES, (20, "é token = \"0123456789abcdef0123456789abcdef\"")]
    found = by_id(secrets.find_secrets(make(spark, rows)), "n_assign", "n_access", "n_hex", "spans")
    assert found[1] == found[2] == found[3] == (0, 0, 0, "")
    assert found[20] == (1, 0, 1, "assign:2:43,hex:11:43")
    assert secrets.find_secrets(make(spark, rows)).count() == len(rows)
    assert secrets.find_secrets(make(spark, [])).collect() == []
