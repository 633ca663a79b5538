"""Secret scans: patterns find candidates, and their structure confirms the encoded ones."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Patterns of the three base kinds; upper and lower case are ASCII's.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order in which spans at one start are listed; the last four are confirmed by structure.
KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "sshkey"]
_NAMES = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_JWT = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s*[A-Za-z0-9-]+:[^\n]*\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")


def decode64(text: str) -> bytes:
    """Base64 in either alphabet, padded or not; empty if it isn't that."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return b""
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_items(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of consecutive DER values that fill data exactly; empty if lengths don't nest."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return []
        tag, n = data[i], data[i + 1]
        i += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or i + k > len(data):
                return []
            n = int.from_bytes(data[i : i + k], "big")
            i += k
        if i + n > len(data):
            return []
        out.append((tag, data[i : i + n]))
        i += n
    return out


def is_private_der(data: bytes) -> bool:
    """A sequence that holds key material: RSA or DSA integers, SEC1, PKCS#8, or PKCS#8 encrypted."""
    top = der_items(data)
    if len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_items(top[0][1])
    tags = [t for t, _ in inner]

    def named(i: int) -> bool:
        first = der_items(inner[i][1])
        return bool(first) and first[0][0] == 0x06

    if tags == [0x30, 0x04]:  # an algorithm's name and the encrypted key
        return named(0) and len(inner[1][1]) >= 16
    if len(inner) < 2 or tags[0] != 0x02 or len(inner[0][1]) != 1:
        return False
    integers = set(tags[:9]) == {0x02} and (len(tags) >= 9 or len(tags) == 6 and inner[0][1] == b"\0" and len(inner[1][1]) >= 32)
    wrapped = tags[1] == 0x30 and 0x04 in tags[2:] and named(1)
    return integers or wrapped or (tags[1] == 0x04 and len(inner[1][1]) >= 16)


def is_ssh_key(data: bytes) -> bool:
    """The container of a private SSH key, or length-prefixed fields that begin with a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    i, fields = 0, []
    while i + 4 <= len(data):
        n = int.from_bytes(data[i : i + 4], "big")
        if n > len(data) - i - 4:
            return False
        fields.append(data[i + 4 : i + 4 + n])
        i += 4 + n
    return i == len(data) and len(fields) >= 2 and re.match(rb"(ssh-|ecdsa-sha2-|sk-)[a-z0-9@.-]+$", fields[0]) is not None


def is_jwt(token: str) -> bool:
    """Header and claims decode to JSON objects and the header names an algorithm."""
    try:
        head, claims = (json.loads(decode64(x)) for x in token.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict)


_KEYS = (("der", is_private_der), ("sshkey", is_ssh_key))


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, by start, then kind as listed, then end; code points."""
    found = []
    if _NAMES.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for m in _ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0:
            raw = bytes.fromhex(m[0])
            found += [(m.start(), m.end(), kind) for kind, test in _KEYS if test(raw)]
    if "ey" in text:
        found += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_jwt(m[0])]
    pems = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            raw = decode64("".join(m[3].split()))
            if is_private_der(raw) or is_ssh_key(raw) or "Proc-Type: 4,ENCRYPTED" in m[2] and len(raw) >= 32:
                pems.append((m.start(), m.end()))
        found += [(*p, "pem") for p in pems]
    for m in _BASE64.finditer(text):
        raw = decode64(m[0])
        inside = any(a <= m.start() < b for a, b in pems)
        found += [(m.start(), m.end(), kind) for kind, test in _KEYS if raw and not inside and not _ANY_HEX.fullmatch(m[0]) and test(raw)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _rows(batches):
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            found = scan(text) if text else []
            base = [x for x in found if x[2] in KINDS[:3]]
            count = [sum(x[2] == k for x in base) for k in KINDS[:3]]
            join = lambda xs: ",".join(f"{k}:{a}:{b}" for a, b, k in xs)
            out.append((*count, hashlib.sha256(join(base).encode()).hexdigest(), join(found)))
        values = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, values, kinds)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of docs (doc_id, text).

    Candidates in base64 or hex (either case) are decoded and reported only if they parse: DER private
    keys (RSA, DSA, SEC1, PKCS#8, encrypted PKCS#8), SSH keys, PEM blocks around any of these or with
    an encryption header, and signed tokens with a JSON header and claims.  A text is scanned whole,
    one at a time, however long it is; values nested too deep to parse are no token.
    Null or empty text finds nothing; its digest is that of the empty string.  Rows with null
    doc_id and repeated rows get their rows; other columns are ignored; an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
