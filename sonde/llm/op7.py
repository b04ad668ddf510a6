"""Secret scans: patterns, and candidates confirmed by decoding and parsing their structure."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")   # runs are maximal either way, so this drops those that are too short
_SIGNED = re.compile(r"ey[A-Z][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
_PACKED = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-Za-z0-9+/]{31,}|AAAA[A-Za-z0-9+/]{28,}|b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/]+)={0,2}")
_HEXED = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")
# Quick tests on whole columns: a text without any of these has no span.
_QUICK = {"assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']? *[:=]""", "access": "AKIA", "hex": "[0-9a-f]{24}", "token": r"ey[A-Z][A-Za-z0-9_-]{8}",
          "key": r"-----BEGIN |M[A-Za-z0-9+/]{31}|AAAA[A-Za-z0-9+/]{28}|b3BlbnNzaC1rZXktdjE|30[0-9A-Fa-f]{62}"}


def _length(data: bytes, at: int) -> tuple[int, int]:
    """(content start, content end) of the element whose length byte is at `at`; -1 if it is malformed."""
    if at >= len(data):
        return -1, -1
    size, at = data[at], at + 1
    if size >= 128:
        many = size & 127
        if not 1 <= many <= 4 or at + many > len(data):
            return -1, -1
        size, at = int.from_bytes(data[at:at + many], "big"), at + many
    return (at, at + size) if at + size <= len(data) else (-1, -1)


def nested(data: bytes) -> bool:
    """A SEQUENCE that fills the data, whose elements fill it in turn, the first one an integer or a sequence."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    start, end = _length(data, 1)
    if start < 0 or end != len(data) or data[start] not in (0x02, 0x30):
        return False
    parts = 0
    while start < end:
        inner, stop = _length(data, start + 1)
        if inner < 0 or stop > end:
            return False
        start, parts = stop, parts + 1
    return parts >= 2


def prefixed(data: bytes) -> bool:
    """Length-prefixed fields that name an algorithm first, or the header of a private key file of that kind."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at:at + 4], "big")
        if size > len(data) - at - 4:
            return False
        fields.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and bool(re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", fields[0]))


def _unpacked(text: str) -> bytes:
    body = "".join(text.split()).translate(str.maketrans("-_", "+/")).rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def signed(text: str) -> bool:
    """Three parts, the first of which decodes to a JSON object that names its algorithm."""
    try:
        header = json.loads(_unpacked(text.split(".", 1)[0]))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def find(text: str, may: tuple[bool, ...] = (True,) * len(KINDS)) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans in code points, sorted; `may` says which kinds can occur."""
    out = []
    if may[0]:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if may[1]:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if may[2]:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if may[3]:
        out += [(m.start(), 3, m.end()) for m in _SIGNED.finditer(text) if signed(m[0])]
    if may[4]:
        keys = {(m.start(), m.end()) for m in _ARMOUR.finditer(text) if nested(d := _unpacked(m[2])) or prefixed(d)}
        inside = sorted(keys)
        for m in _PACKED.finditer(text):
            if not any(a <= m.start() < b for a, b in inside) and (nested(d := _unpacked(m[0])) or prefixed(d)):
                keys.add((m.start(), m.end()))
        for m in _HEXED.finditer(text):
            body = m[0]
            if len(body) % 2 == 0 and nested(bytes.fromhex(body)):
                keys.add((m.start(), m.end()))
        out += [(a, 4, b) for a, b in keys]
    return sorted(out)


def _say(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_confirmed of every row, from its whole text.

    Base kinds are plain patterns.  `token` spans decode to a signed token's header; `key` spans (armoured, base64
    or hex) decode to nested lengths that add up, or to length-prefixed key fields.  Null texts are empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            may = [pc.match_substring_regex(column, _QUICK[k]).to_pylist() for k in KINDS]
            counts, sha, said, more = ([], [], []), [], [], []
            blank = hashlib.sha256(b"").hexdigest()
            for i, row in enumerate(zip(*may)):
                spans = find(column[i].as_py(), row) if any(row) else []
                kinds = [k for _, k, _ in spans]
                for k in range(3):
                    counts[k].append(kinds.count(k))
                sha.append(hashlib.sha256(_say(s for s in spans if s[1] < 3).encode()).hexdigest() if spans else blank)
                said.append(_say(spans))
                more.append(sum(k > 2 for k in kinds))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(said, pa.string()),
                 pa.array(more, pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_confirmed bigint")
