import base64
import hashlib
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import odd_rows  # noqa: E402
import pytest  # noqa: E402

from contactweave.llm import secret_scan  # noqa: E402


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def number(n):
    body = n.to_bytes(n.bit_length() // 8 + 1, "big")
    return der(2, body)


RSA_ID = der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b""))
PKCS1 = der(0x30, number(0) + b"".join(number(3 << 300 + k) for k in range(8)))
PKCS8 = der(0x30, number(0) + RSA_ID + der(4, PKCS1))
ENCRYPTED = der(0x30, RSA_ID + der(4, b"e" * 200))
SEC1 = der(0x30, number(1) + der(4, b"k" * 32) + der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")) + der(0xA1, der(3, b"\0" + b"p" * 64)))
DSA = der(0x30, number(0) + b"".join(number(5 << 200 + k) for k in range(5)))
PUBLIC = der(0x30, RSA_ID + der(3, b"\0" + der(0x30, number(3 << 900) + number(65537))))
PUBLIC1 = der(0x30, number(3 << 900) + number(65537))
CERTIFICATE = der(0x30, der(0x30, number(7) + RSA_ID + PUBLIC) + RSA_ID + der(3, b"\0" + b"s" * 128))
TOKEN = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"1"}', b"signature-bytes"))


def field(data):
    return len(data).to_bytes(4, "big") + data


SSH_PUBLIC = field(b"ssh-ed25519") + field(b"p" * 32)
SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(SSH_PUBLIC) + field(b"private" * 20)


def b64(data):
    return base64.b64encode(data).decode()


def lines(data, end="\n"):
    text = b64(data)
    return end.join(text[i : i + 64] for i in range(0, len(text), 64))


def spans(text):
    return [(secret_scan.KINDS[k], text[a:b]) for a, k, b in sorted(secret_scan.confirmed_spans(text))]


def kinds(text):
    return [k for k, _ in spans(text)]


@pytest.mark.parametrize("key", [PKCS1, PKCS8, ENCRYPTED, SEC1, DSA])
def test_private_keys_in_every_form(key):
    assert spans(f"key {b64(key)} end") == [("der", b64(key))]
    assert spans(f"key ab{key.hex()} end") == [("der", key.hex())]
    assert spans(f"30 {key.hex().upper()}30") == [("der", key.hex().upper())]
    wrapped = lines(key)
    assert spans(f"take\n{wrapped}\nand more words follow") == [("der", wrapped)]
    pem = f"-----BEGIN PRIVATE KEY-----\n{wrapped}\n-----END PRIVATE KEY-----"
    assert spans(f"x {pem} y") == [("der", pem)]
    escaped = pem.replace("\n", "\\n")
    assert spans('{"key": "' + escaped + '"}') == [("der", escaped)]
    assert spans("A" * 60 + " plain words and " + b64(key)) == [("der", b64(key))]
    for at in (0, 1, len(key) // 2):
        broken = bytearray(key)
        broken[at] ^= 0x21 if at else 0x01
        assert at > 1 or kinds(b64(bytes(broken))) == []
    assert kinds(b64(key[:-1])) == [] and kinds(key[:-1].hex()) == []


@pytest.mark.parametrize("public", [PUBLIC, PUBLIC1, CERTIFICATE, SSH_PUBLIC])
def test_public_parts_are_left_alone(public):
    for text in (b64(public), lines(public), public.hex(), f"-----BEGIN CERTIFICATE-----\n{lines(public)}\n-----END CERTIFICATE-----", f"ssh-ed25519 {b64(public)} me"):
        assert kinds(text) == []


def test_openssh_containers_and_tokens():
    assert spans(f"a {b64(SSH)} b") == [("openssh", b64(SSH))]
    assert spans(f"a\n{lines(SSH)}\nb c") == [("openssh", lines(SSH))]
    assert kinds(b64(SSH[:-1])) == []
    assert kinds(f"bearer {TOKEN}") == ["token"]
    assert kinds("A" * 200) == [] and kinds("eyJhbGciOiJub3BlIn0.eyJ9.x") == []
    assert kinds("the quick brown fox " * 50) == []


def test_hostile_texts_end():
    nested = base64.urlsafe_b64encode(b'{"a":' + b"[" * 20_000).decode().rstrip("=")
    short = base64.urlsafe_b64encode(b'{"a":' + b"[" * 5_000).decode().rstrip("=")
    assert kinds(f"{nested}.eyJ9.x") == [] and kinds(f"{short}.eyJ9.x {TOKEN}") == ["token"]
    deep = b""
    for _ in range(60):
        deep = der(0x30, deep)
    assert kinds(b64(deep + b"x" * 40)) == []
    assert kinds("30" * 50_000) == [] and kinds("MIIE" * 50_000) == [] and kinds("M" * 40 + "\nA" * 50_000) == []


def test_base_spans_by_brute_force():
    text = "Token: 'abcdefghijkl' secret=short PASSWD = \"aaaaaaaaaaaa\" api-key:zzzzzzzzzzzzzz AKIA" + "B" * 14 + " AKIAX deadbeefdeadbeef deadbeef ſecret=abcdefghijklmnop api_key=" + "0" * 40
    want = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            want.append((m.start(), 0, m.end()))
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert sorted(secret_scan.base_spans(text)) == sorted(want)
    assert len(want) == 6


def test_every_row(spark):
    extra = spark.createDataFrame([(50, f"😀 token = '{TOKEN}' x", "en", None, 1)], odd_rows.SCHEMA)
    docs = odd_rows.documents(spark).unionByName(extra, allowMissingColumns=True)
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(docs)).collect()}
    assert len(got) == 12 and secret_scan.digest(secret_scan.scan(docs)).count() == 13
    end = 11 + len(TOKEN)
    assert got[50].spans == f"assign:2:{end},token:11:{end}" and got[50].n_assign == 1
    assert got[50].base_sha256 == hashlib.sha256(f"assign:2:{end}".encode()).hexdigest()
    assert got[3].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.scan(odd_rows.nothing(spark)).count() == 0
