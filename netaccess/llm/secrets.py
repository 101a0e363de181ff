"""Secret scan: fixed patterns, plus candidates reported only after their inner structure is confirmed.

Kinds by pattern: ``assign``, ``access``, ``hex``. Kinds by structure: ``pem`` (armour whose base64 decodes to a
private key, its line ends real or written as ``\\n``, or to the whole blocks of the cipher that its header names), ``jwt``
(three base64url parts: a JSON object with an algorithm, a JSON object, a signature), ``der``, ``openssh`` and ``pem64``
(base64 or base64url that is one private key in DER, one OpenSSH container or an armoured key, whole, in one run or in
lines of equal width) and ``hexkey`` (hex that is one private key, whole, its bytes adjacent or set apart by colons).
A private key is a DER sequence with the members of PKCS#1, SEC1, DSA, PKCS#8 or encrypted PKCS#8, every length nested,
or an OpenSSH container. Public keys, certificates and other DER are no secrets. A DER sequence starts with the byte
0x30, hence base64 with ``M`` and hex with ``30``; under 24 bytes cannot hold a key. A key in bare lines states its
length in at most two bytes, and its last line ends where that length does; so each line that could begin a key costs
at most 64 KiB of decoding.

Null and empty texts have no spans. Spans count code points, end exclusive. Long texts are scanned whole, in time
that grows with their length. Rows are independent, so ties and repeated rows need no rule; an empty table gives
an empty result and other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from netaccess.llm.common import map_arrow

KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "hexkey", "openssh", "pem64")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ARMOUR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
LINE_END = r"(?:\r?\n|(?:\\+r)?\\+n)"
LINE_ENDS = re.compile(LINE_END)
# base64 of the byte of a sequence, of the OpenSSH container's name, of the opening of an armour
BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\n))(?:M|(b3BlbnNzaC1rZXktdjE)|(LS0tLS1CRUdJTi))[A-Za-z0-9+/_-]{15,}={0,2}")
NEXT_LINE = re.compile(LINE_END + r"[ \t]*([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])")
HEXKEY = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{62,}|(?::\s{0,40}[0-9A-Fa-f]{2}){31,})(?![0-9A-Fa-f])")
CIPHER = re.compile(r"DEK-Info:[ \t]*([A-Z0-9-]+),([0-9A-Fa-f]+)")
KEYWORD = re.compile(r"(?i:passw|secret|token|api_?key)")
#: fixed values: block bytes of the ciphers of an encrypted armour
CIPHER_BLOCKS = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}


INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
# fixed values: object identifiers, as DER contents
RSA_KEY, EC_KEY = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def members(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of a run of DER values that fills the data exactly; None if any length does not fit."""
    found, at, end = [], 0, len(data)
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > end:
                return None
            size, at = int.from_bytes(data[at : at + count], "big"), at + count
        if at + size > end or (tag == INTEGER and size == 0):
            return None
        found.append((tag, data[at : at + size]))
        at += size
    return found


def sequence(data: bytes) -> list[tuple[int, bytes]]:
    """Members of the one sequence that fills the data; none if it is anything else."""
    outer = members(data)
    return (members(outer[0][1]) or []) if outer and len(outer) == 1 and outer[0][0] == SEQUENCE else []


def is_der_key(data: bytes) -> bool:
    """Whether the data is one private key: the members decide, and what they hold is parsed in turn."""
    parts = sequence(data)
    tags = [t for t, _ in parts]
    if len(tags) < 2:
        return False
    if tags[:2] == [SEQUENCE, OCTETS] and len(tags) == 2:  # encrypted PKCS#8: the method and the sealed key
        method = members(parts[0][1]) or []
        return bool(method) and method[0][0] == OID and method[0][1].startswith(ENCRYPTIONS) and len(parts[1][1]) >= 16
    if tags[0] != INTEGER or parts[0][1] not in (b"\0", b"\1"):
        return False
    if set(tags) == {INTEGER} and len(tags) in (6, 9):  # DSA, PKCS#1
        return len(max((v for _, v in parts), key=len)) >= 16
    if tags[:3] == [INTEGER, INTEGER, INTEGER]:  # PKCS#1 with more primes
        return len(tags) == 10 and tags[9] == SEQUENCE
    if tags[1] == OCTETS:  # SEC1: the key, then optional context tags
        return len(parts[1][1]) >= 16 and set(tags[2:]) <= {0xA0, 0xA1} and all(members(v) is not None for _, v in parts[2:])
    if tags[1:3] == [SEQUENCE, OCTETS] and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:  # PKCS#8: algorithm, key
        method = members(parts[1][1]) or []
        if not method or method[0][0] != OID:
            return False
        inner = parts[2][1]
        if method[0][1] in (RSA_KEY, EC_KEY):
            return is_der_key(inner)
        return len(inner) >= 16 and members(inner) is not None
    return False


def is_openssh_key(data: bytes) -> bool:
    """The OpenSSH container: its name, names of cipher and derivation, public keys with their type, a sealed part that ends it."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data)
        begin, at = at + 4, at + 4 + size
        return data[begin:at] if at <= len(data) else None

    cipher, derivation, options = string(), string(), string()
    if not cipher or not derivation or options is None or not (cipher + derivation).isascii() or at + 4 > len(data):
        return False
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(min(count, len(data))):
        public = string()
        size = int.from_bytes(public[:4], "big") if public else 0
        if not 1 <= size <= len(public or b"") - 4:
            return False
    sealed = string()
    return count >= 1 and sealed is not None and len(sealed) >= 16 and len(sealed) % 8 == 0 and at == len(data)


def is_sealed(head: str, data: bytes) -> bool:
    """Whether the data is whole blocks of the cipher that an armour's header names with a start value of its size."""
    m = CIPHER.search(head)
    block = CIPHER_BLOCKS.get(m[1], 0) if m else 0
    return bool(block) and len(m[2]) == 2 * min(block, 16) and len(data) >= 32 and len(data) % block == 0


def is_armoured_key(body: str) -> bool:
    """Whether what stands between the lines of an armour is a private key."""
    lines = LINE_ENDS.split(body)
    head = [x for x in lines if ":" in x]
    data = decode64("".join(x for x in lines if ":" not in x))
    if not data:
        return False
    return is_sealed("\n".join(head), data) if any("ENCRYPTED" in x for x in head) else is_der_key(data) or is_openssh_key(data)


def decode64(text: str) -> bytes | None:
    body = "".join(text.split()).replace("-", "+").replace("_", "/").rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def json_object(part: str) -> dict | None:
    data = decode64(part)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(header: str, payload: str, signature: str) -> bool:
    head = json_object(header)
    return head is not None and isinstance(head.get("alg"), str) and json_object(payload) is not None and decode64(signature) is not None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if KEYWORD.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def armoured_spans(text: str) -> list[tuple[int, int]]:
    found, opened = [], {}
    for m in ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            opened[m[2]] = m
        elif (begin := opened.pop(m[2], None)) and is_armoured_key(text[begin.end() : m.start()]):
            found.append((begin.start(), m.end()))
    return found


def is_armoured_text(data: bytes) -> bool:
    """Whether decoded base64 is a text with an armoured private key."""
    return data.startswith(b"-----BEGIN") and bool(armoured_spans(data.decode("latin-1")))


def characters_of_key(first: str) -> int:
    """Base64 characters, without padding, of the DER sequence that a run begins, by its stated length; 0 if that is none of a key in lines."""
    head = decode64(first[:16])
    if not head or head[1] in (0x80, 0xFF) or head[1] > 0x82:
        return 0
    more = head[1] & 0x7F if head[1] & 0x80 else 0
    if not head.startswith((b"\x02\x01\0", b"\x02\x01\1", b"\x30"), 2 + more):
        return 0
    size = 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])
    return -(-4 * size // 3)


Block = tuple[list[str], list[int], int]


def block_of(text: str, first: re.Match, known: dict[int, Block]) -> Block:
    """The lines around a run that are as wide, to the first that is narrower or padded; their ends; the run's place. Each block is read once."""
    if first.start() not in known:
        lines, ends, starts = [first[0]], [first.end()], [first.start()]
        width = len(first[0])
        while len(lines[-1]) == width and lines[-1][-1] != "=" and (m := NEXT_LINE.match(text, ends[-1])) and len(m[1]) <= width:
            lines.append(m[1])
            ends.append(m.end())
            starts.append(m.start(1))
        for i, at in enumerate(starts):
            known[at] = lines, ends, i
    return known[first.start()]


def key_in_lines(text: str, first: re.Match, known: dict[int, Block]) -> Iterator[tuple[str, int]]:
    """What one key may be that starts with the run and goes on in lines: its characters and its end."""
    begin = first[1] or first[2]
    enough = 0 if begin else characters_of_key(first[0])
    if not begin and enough <= len(first[0]):
        return
    lines, ends, at = block_of(text, first, known)
    if not begin:
        n = -(-enough // len(first[0]))
        if at + n <= len(lines) and (n - 1) * len(first[0]) + len(lines[at + n - 1].rstrip("=")) == enough:
            yield "".join(lines[at : at + n]), ends[at + n - 1]
        return
    n = next((k for k in range(at + 1, len(lines)) if lines[k].startswith(begin)), len(lines))
    for end in (n, n - 1) if len(lines[n - 1]) < len(first[0]) else (n,):
        if end > at + 1:
            yield "".join(lines[at:end]), ends[end - 1]


def bare_keys(text: str, pems: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    done, known = 0, {}
    for m in BASE64.finditer(text):
        k = bisect_right(pems, (m.start(), len(text))) - 1
        if m.start() < done or (k >= 0 and m.start() < pems[k][1]):
            continue
        kind, confirmed = ("openssh", is_openssh_key) if m[1] else ("pem64", is_armoured_text) if m[2] else ("der", is_der_key)
        if (data := decode64(m[0])) and confirmed(data):
            yield m.start(), m.end(), kind
            continue
        for held, end in key_in_lines(text, m, known):
            if (data := decode64(held)) and confirmed(data):
                done = end
                yield m.start(), end, kind
                break


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    pems = sorted(armoured_spans(text)) if "-----BEGIN" in text else []
    found = [(a, b, "pem") for a, b in pems]
    if "eyJ" in text:
        found += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_token(m[1], m[2], m[3])]
    found += bare_keys(text, pems)
    for m in HEXKEY.finditer(text):
        digits = re.sub(r"[:\s]", "", m[0])
        if len(digits) % 2 == 0 and is_der_key(bytes.fromhex(digits)):
            found.append((m.start(), m.end(), "hexkey"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCHEMA = StructType([StructField("doc_id", LongType()), *(StructField(n, LongType()) for n in ("n_assign", "n_access", "n_hex", "n_confirmed")), StructField("base_spans", StringType()), StructField("base_sha256", StringType()), StructField("spans", StringType())])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of (doc_id, text): counts by pattern, confirmed candidates, and every span."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in SCHEMA}
            for doc_id, value in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = value.as_py() or ""
                base, more = base_spans(text), structural_spans(text)
                kinds = [kind for _, _, kind in base]
                base_text = joined(base)
                out["doc_id"].append(doc_id)
                out["n_assign"].append(kinds.count("assign"))
                out["n_access"].append(kinds.count("access"))
                out["n_hex"].append(kinds.count("hex"))
                out["n_confirmed"].append(len(more))
                out["base_spans"].append(base_text)
                out["base_sha256"].append(hashlib.sha256(base_text.encode()).hexdigest())
                out["spans"].append(joined(base + more))
            yield out

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)
