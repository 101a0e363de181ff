"""Forms in which keys leak: escaped line ends, encrypted armour, encoded armour, bare lines, base64url, colons."""

import base64
import json
import textwrap

import pytest

from netaccess.llm import secrets

from .test_secrets_whole import BIG, CERTIFICATE, EC, PKCS8, PUBLIC, RSA, kinds

KEYS = (RSA, EC, PKCS8)


def b64(data, width=64):
    return "\n".join(textwrap.wrap(base64.b64encode(data).decode(), width))


def armour(body, name="PRIVATE KEY"):
    return f"-----BEGIN {name}-----\n{body}\n-----END {name}-----\n"


def string(x):
    return len(x).to_bytes(4, "big") + x


def openssh(cipher=b"none", derivation=b"none", public=None, sealed=bytes(64), more=b""):
    public = string(b"ssh-ed25519") + string(bytes(32)) if public is None else public
    return b"openssh-key-v1\0" + string(cipher) + string(derivation) + string(b"") + (1).to_bytes(4, "big") + string(public) + string(sealed) + more


@pytest.mark.parametrize("key", KEYS)
def test_escaped_line_ends(key):
    plain = armour(b64(key))
    for text in (json.dumps({"private_key": plain, "id": 7}), json.dumps(json.dumps({"k": plain})), plain.replace("\n", "\r\n"), 'KEY = "' + plain.replace("\n", "\\r\\n") + '"'):
        (a, b, kind), = secrets.structural_spans(text)
        assert kind == "pem" and text[a:b].startswith("-----BEGIN") and text[a:b].endswith("-----")


def test_encrypted_armour():
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: {},{}\n\n"
    good = [("AES-128-CBC", "0" * 32, 64), ("DES-EDE3-CBC", "A" * 16, 40)]
    bad = [("AES-128-CBC", "0" * 32, 60), ("AES-128-CBC", "0" * 16, 64), ("ROT13", "0" * 16, 64), ("DES-CBC", "0" * 16, 16)]
    for cases, want in ((good, {"pem"}), (bad, set())):
        for name, start, size in cases:
            assert kinds(armour(head.format(name, start) + b64(bytes(range(size))), "RSA PRIVATE KEY")) == want


@pytest.mark.parametrize("key", KEYS)
def test_bare_lines(key):
    for body in (b64(key), b64(key, 76), "  " + b64(key).replace("\n", "\n  "), b64(key).replace("\n", "\r\n"), b64(key).replace("\n", "\\n")):
        for after in ("", "\nThen words follow", "\n" + "x" * 64):
            text = f"the key\n{body}{after}"
            (a, b, kind), = secrets.structural_spans(text)
            assert kind == "der" and text[a:b].strip() == body.strip()
    assert not kinds("the key\n" + b64(key[:-40])) and not kinds("the key\n" + b64(key).replace("\n", "\n\n"))


def test_what_is_no_key_in_lines():
    for data in (CERTIFICATE, PUBLIC):
        assert not kinds("look\n" + b64(data))


def test_base64url_and_colons():
    key = secrets.base64.urlsafe_b64encode(RSA).decode()
    assert kinds(f"k={key} end") == {"der"} and kinds(f"k={key.rstrip('=')} end") == {"der"}
    dashed = next(k for n in range(200) if {"-", "_"} & set(k := base64.urlsafe_b64encode(EC[:7] + bytes([n, 255 - n] * 16) + EC[39:]).decode()))
    assert kinds(f"k={dashed} end") == {"der"}
    colons = ":".join(f"{b:02x}" for b in RSA)
    lines = ":\n    ".join(":".join(f"{b:02X}" for b in RSA[k : k + 15]) for k in range(0, len(RSA), 15))
    assert kinds(f"x {colons} y") == {"hexkey"} and kinds(f"x {lines} y") == {"hexkey"}
    assert not kinds(f"x {colons[:-3]} y")


def test_openssh_containers():
    good = openssh()
    assert kinds(armour(b64(good, 70), "OPENSSH PRIVATE KEY")) == {"pem"}
    assert all(kinds("key\n" + b64(good, w) + "\nwords") == {"openssh"} for w in (40, 60, 64, 70, 76)) and kinds(f"k {b64(good, 9999)} k") == {"openssh"}
    bad = [openssh(cipher=b""), openssh(derivation=b""), openssh(public=b""), openssh(public=string(b"")), openssh(sealed=b""), openssh(sealed=bytes(17)), openssh(more=b"\0"), good[:-1], b"openssh-key-v1\0" + bytes(16)]
    for data in bad:
        assert not secrets.is_openssh_key(data) and not kinds(armour(b64(data, 70), "OPENSSH PRIVATE KEY")) and not kinds("key\n" + b64(data, 70))


def test_base64_of_an_armour():
    for key in KEYS:
        inner = armour(b64(key)).encode()
        assert kinds(f"data: {b64(inner, 9999)} end") == {"pem64"} and kinds("data:\n" + b64(inner, 76)) == {"pem64"}
    assert not kinds(f"data: {b64(armour(b64(PUBLIC), 'PUBLIC KEY').encode(), 9999)} end")


def test_hostile_lines_take_linear_time():
    import time

    long = base64.b64encode(b"\x30\x82\xbf\xfc\x02\x01\0" + bytes(41)).decode()
    many = "\n".join([long] * 10_000), "\n".join([base64.b64encode(openssh()).decode()[:64]] * 20_000), "\n".join(["LS0tLS1CRUdJTi" + "A" * 50] * 20_000), "30:" * 300_000, ("30:" + " " * 39) * 20_000, "M" * 16 + "\n" + "\n".join(["A" * 16] * 60_000)
    for text in many:
        began = time.time()
        assert not secrets.structural_spans(text)
        assert time.time() - began < 6


def test_big_key_in_one_run():
    key = secrets.base64.b64encode(b"\x30\x82" + len(body := b"\x02\x01\0" + BIG * 8).to_bytes(2, "big") + body).decode()
    assert kinds("M" + key) == set() and kinds("=" + key) == {"der"}
