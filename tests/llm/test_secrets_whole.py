"""Keys and what only looks like one: arbitrary DER, certificates, public keys, tokens without a JSON payload."""

import base64
import re
import time

from netaccess.llm import secrets


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def integer(n):
    return der(2, n.to_bytes(max(1, (n.bit_length() + 8) // 8), "big"))


BIG = integer(2**255 + 9)
RSA = der(0x30, integer(0), *[BIG] * 8)
RSA_ID = der(0x30, der(6, secrets.RSA_KEY), der(5))
EC = der(0x30, integer(1), der(4, bytes(32)), der(0xA1, der(3, bytes(65))))
PKCS8 = der(0x30, integer(0), RSA_ID, der(4, RSA))
ED25519 = der(0x30, integer(0), der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, der(4, bytes(range(32)))))
SEALED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30)), der(4, bytes(64)))
DSA = der(0x30, integer(0), *[BIG] * 5)
STRINGS = der(0x30, der(12, b"x" * 30), der(12, b"y" * 30))
PUBLIC = der(0x30, RSA_ID, der(3, b"\0" + der(0x30, BIG, integer(65537))))
CERTIFICATE = der(0x30, der(0x30, der(0xA0, integer(2)), BIG, RSA_ID, der(0x30)), RSA_ID, der(3, bytes(64)))


def kinds(text):
    return {kind for _, _, kind in secrets.structural_spans(text)}


def test_private_keys():
    for key in (RSA, EC, PKCS8, ED25519, SEALED, DSA):
        b64 = base64.b64encode(key).decode()
        assert kinds(f"key {b64} end") == {"der"} and kinds(f"key {key.hex()} end") == {"hexkey"}
        assert kinds(f"-----BEGIN PRIVATE KEY-----\n{b64}\n-----END PRIVATE KEY-----") == {"pem"}


def test_no_private_keys():
    for key in (STRINGS, PUBLIC, CERTIFICATE, RSA[:-1], RSA + b"\0", der(0x30, integer(0), RSA_ID, der(4, EC[:-3])), der(0x30, integer(7), *[BIG] * 8)):
        b64 = base64.b64encode(key).decode()
        assert not kinds(f"key {b64} end") and not kinds(f"key {key.hex()} end")
        assert not kinds(f"-----BEGIN PRIVATE KEY-----\n{b64}\n-----END PRIVATE KEY-----")


def token(*parts):
    return ".".join(base64.urlsafe_b64encode(p).decode().rstrip("=") for p in parts)


def test_tokens():
    assert kinds(token(b'{"alg":"HS256"}', b'{"a":1}', b"sig")) == {"jwt"}
    for parts in ((b'{"typ":"x"}', b"{}", b"s"), (b'{"alg":"HS256"}', b"hello there", b"s"), (b'{"alg":1}', b"{}", b"s"), (b'{"alg":"HS256"}', b"[1]", b"s")):
        assert not kinds(token(*parts))


def test_hostile_texts_take_linear_time():
    for text in ("-----BEGIN PRIVATE KEY-----\n" * 40_000, "M" + "A" * 1_000_000, "30" * 500_000, "-----BEGIN A PRIVATE KEY-----" * 40_000 + "-----END A PRIVATE KEY-----" * 40_000, "eyJ" * 300_000):
        began = time.time()
        secrets.structural_spans(text)
        assert time.time() - began < 3


def test_rows(spark):
    text = "password = hunter22 deadbeef" + "0123456789abcdef" * 2
    rows = [(1, text, "x"), (1, text, "x"), (None, text, "x"), (2, None, "x"), (3, "é " * 100_000 + text, "x")]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == 5 and [r["n_assign"] for r in got if r["doc_id"] != 2] == [1] * 4
    long = next(r for r in got if r["doc_id"] == 3)
    assert [int(x.split(":")[1]) for x in long["spans"].split(",")] == [200_000 + m.start() for m in re.finditer("password|deadbeef", text)]
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
