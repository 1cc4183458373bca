"""Secret scans with structural confirmation.

Fixed patterns find assignments, access keys and hex runs.  Besides those,
base64 runs (over several lines too), hex runs and PEM bodies are candidates:
each is decoded and reported only if its bytes are a private key or a signed
token.  Keys are read field by field: PKCS#1, PKCS#8 (plain and encrypted),
SEC 1 and DSA sequences whose nested lengths add up, and OpenSSH containers
whose length-prefixed fields fill them.  Public keys and certificates are not
reported.  A token's header has to be JSON that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contactweave.llm.common import slices

KINDS = ("assign", "access", "hex", "der", "openssh", "token")
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_BREAK = r"[\x20\t]*(?:\r?\n|\\r\\n|\\n)[\x20\t]*"  # a line break may be written out, as in JSON
_PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]+)-----((?:[A-Za-z0-9+/=\s]|\\[nr])+)-----END \1-----")
# what base64 of a sequence or of an OpenSSH container begins with
_START = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{39,}")
_LINES = re.compile(rf"[A-Za-z0-9+/_-]+(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
_ONE_BREAK, _PADDING = re.compile(_BREAK), re.compile("={0,2}")
# a sequence with its length, and a version number or a sequence in it
_HEX_KEY = re.compile(r"(?=(30(?:[2-7][0-9a-fA-F]|81[89a-fA-F][0-9a-fA-F]|82[0-9a-fA-F]{4}|83[0-9a-fA-F]{6})(?:0201|30)))")
_ALGORITHM = re.compile(r"none|(?:HS|RS|ES|PS)(?:256|384|512)|EdDSA|ES256K|(?:RSA|ECDH|A\d{3}|dir).*")
_HEADER_MOST = 8_192  # characters of a token's header
_DEPTH_MOST = 12
_KEY_LEAST, _KEY_MOST = 40, 1 << 16  # bytes of a key
INTEGER, BITS, OCTETS, NULL, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x05, 0x06, 0x30


def decode(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, or None."""
    run = re.sub(r"\s|\\[nr]", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def der_length(data: bytes) -> int | None:
    """Bytes of the DER value that ``data`` begins with, its head included, or None."""
    if len(data) < 2 or data[0] in (0, 0x1F) or data[0] & 0x1F == 0x1F:
        return None
    n = data[1]
    if n < 0x80:
        return 2 + n
    n &= 0x7F
    if not 1 <= n <= 4 or len(data) < 2 + n or data[2] == 0:
        return None
    length = int.from_bytes(data[2 : 2 + n], "big")
    return 2 + n + length if length >= 0x80 else None


def der_values(data: bytes, depth: int = 0) -> list[tuple[int, bytes | list]] | None:
    """Tags and contents of a row of complete DER values, nested ones as lists, else None."""
    at, out = 0, []
    while at < len(data):
        size = der_length(data[at : at + 6]) if depth <= _DEPTH_MOST else None
        if size is None or at + size > len(data):
            return None
        tag = data[at]
        head = 2 + (data[at + 1] & 0x7F if data[at + 1] >= 0x80 else 0)
        body = data[at + head : at + size]
        if tag & 0x20:
            inner = der_values(body, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        elif tag == INTEGER and (not body or len(body) > 1 and body[0] == 0 and body[1] < 0x80):
            return None
        elif tag == NULL and body:
            return None
        else:
            out.append((tag, body))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """A private key in PKCS#1, PKCS#8, encrypted PKCS#8, SEC 1 or DSA form that spans all bytes."""
    if not _KEY_LEAST <= len(data) <= _KEY_MOST or der_length(data) != len(data):
        return False
    outer = der_values(data)
    if not outer or outer[0][0] != SEQUENCE:
        return False
    values = outer[0][1]
    tags = [t for t, _ in values]
    version = int.from_bytes(values[0][1], "big") if tags[:1] == [INTEGER] else None
    algorithm = next((v for t, v in values if t == SEQUENCE), [])
    named = bool(algorithm) and algorithm[0][0] == OID
    if version in (0, 1) and tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS#8
        return named and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:])
    if version in (0, 1) and tags[:9] == [INTEGER] * 9:  # PKCS#1
        return tags[9:] in ([], [SEQUENCE])
    if version == 1 and tags[:2] == [INTEGER, OCTETS]:  # SEC 1
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    if version == 0 and tags == [INTEGER] * 6:  # DSA
        return True
    return tags == [SEQUENCE, OCTETS] and named  # encrypted PKCS#8


def _fields(data: bytes, n: int) -> tuple[list[bytes], bytes] | None:
    """The first ``n`` length-prefixed fields and what follows them."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[:4], "big")
        if len(data) < 4 or size > len(data) - 4:
            return None
        out.append(data[4 : 4 + size])
        data = data[4 + size :]
    return out, data


def openssh_length(data: bytes) -> int | None:
    """Bytes of the ``openssh-key-v1`` container that ``data`` begins with: ciphers, public keys and the private part."""
    magic = b"openssh-key-v1\0"
    head = _fields(data[len(magic) :], 3) if data.startswith(magic) else None  # cipher, key derivation, its options
    if head is None or len(head[1]) < 4:
        return None
    n = int.from_bytes(head[1][:4], "big")
    rest = _fields(head[1][4:], n + 1) if 1 <= n <= 16 else None  # public keys, private part
    return len(data) - len(rest[1]) if rest and rest[0][-1] else None


def is_openssh_key(data: bytes) -> bool:
    return openssh_length(data) == len(data)


def _key_in(run: str) -> tuple[int, int] | None:
    """Kind and characters of the key that a base64 run, which may go on over lines, begins with."""
    chars = _ONE_BREAK.sub("", run).rstrip("=")
    data = decode(chars if len(chars) % 4 != 1 else chars[:-1])
    if not data:
        return None
    kind, size = (3, der_length(data)) if data[0] == SEQUENCE else (4, openssh_length(data))
    if size is None or size > len(data) or kind == 3 and not is_der_key(data[:size]):
        return None
    wanted, at = (4 * size + 2) // 3, 0  # characters that hold the key, line breaks not counted
    while wanted:
        skip = _ONE_BREAK.match(run, at)
        at = skip.end() if skip else at + 1
        wanted -= not skip
    return kind, at + len(_PADDING.match(run, at)[0])


def is_signed_token(run: str) -> bool:
    """Three parts of which the header is a JSON object with a known algorithm and the claims are one too."""
    header, claims, _ = run.split(".", 2)
    if len(header) > _HEADER_MOST:
        return False
    try:
        head, body = (json.loads(decode(part) or b"") for part in (header, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str) and bool(_ALGORITHM.fullmatch(head["alg"]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of what the fixed patterns find."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of candidates whose decoded bytes have the structure of a secret."""
    found = []
    if "eyJ" in text:
        found += [(m.start(), 5, m.end()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    taken = [(a, b) for a, _, b in found]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = decode(m[2])
            kind = data and (3 if is_der_key(data) else 4 if is_openssh_key(data) else None)
            if kind:
                found.append((m.start(), kind, m.end()))
                taken.append((m.start(), m.end()))
    end = 0
    for m in _START.finditer(text):
        if m.start() < end or any(a < m.end() and m.start() < b for a, b in taken):
            continue
        key = _key_in(_LINES.match(text, m.start(), m.start() + 2 * _KEY_MOST)[0])
        if key:
            end = m.start() + key[1]
            found.append((m.start(), key[0], end))
    end = 0
    for m in _HEX_KEY.finditer(text):
        if m.start() < end:
            continue
        size = der_length(bytes.fromhex(m[1][:10] if m[1][2] == "8" else m[1][:4]))
        run = text[m.start() : m.start() + 2 * size] if size and size <= _KEY_MOST else ""
        if len(run) == 2 * (size or 0) > 0 and re.fullmatch("[0-9a-fA-F]+", run) and is_der_key(bytes.fromhex(run)):
            end = m.start() + len(run)
            found.append((m.start(), 3, end))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: all spans as start, end, kind and value, by start and then kind as in KINDS.

    Positions are code points, the end is exclusive.  A null or empty text has
    no span; every row, repeated or without doc_id, gives one row.
    """
    schema = "doc_id long, found array<struct<start: long, end: long, kind: string, value: string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2_000):
            rows = []
            for text in part.column(1).to_pylist():
                text = text or ""
                spans = sorted(base_spans(text) + confirmed_spans(text))
                rows.append([{"start": a, "end": b, "kind": KINDS[k], "value": text[a:b]} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the fixed patterns, a digest of their spans, and all spans as text."""

    def joined(base_only: bool):
        spans = F.filter("found", lambda s: s["kind"].isin(*KINDS[:3])) if base_only else F.col("found")
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"))
