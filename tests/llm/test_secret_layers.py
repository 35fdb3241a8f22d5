"""Secrets in awkward layers, and base spans against a plain scanner over all documents."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib

import pytest
import zstandard

from clinprep.llm import queries, secrets
from clinprep.llm.common import load

SECRET = b"the password = hunter2hunter and no more"
ENCODED = base64.b64encode(SECRET).decode()


def found(text):
    return [(secrets.KINDS[k], text[a:b], depth) for a, k, b, depth in secrets.scan_text(text)[0]]


@pytest.mark.parametrize("front", ["https://host/path/", "auth-", "x_", "blob", "a", "ab", "abc", "../data/v1_", "key+", "\u00e9"])
def test_base64_behind_other_characters(front):
    spans = found(f"see {front}{ENCODED} there")
    assert [s[0] for s in spans] == ["assign"] and spans[0][2] >= 1 and spans[0][1] in ENCODED


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress])
@pytest.mark.parametrize("front", ["", "https://host/path/", "auth-", "blob"])
def test_compressed_data_behind_other_characters(pack, front):
    spans = found(f"see {front}{base64.b64encode(pack(SECRET)).decode()} there")
    assert [s[0] for s in spans] == ["assign"] and spans[0][2] >= 1


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress])
def test_all_members_are_unpacked(pack):
    data = pack(b"nothing to see in this one") + pack(b"nor in this one, it is only text") + pack(SECRET)
    assert [s[0] for s in found(base64.b64encode(data).decode())] == ["assign"]


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n  "])
def test_wrapped_base64(pack, newline):
    rng = random.Random(3)
    body = bytes(rng.choice(b"abcdefghij klmnop") for _ in range(50)) + SECRET + bytes(rng.choice(b"abcdefghij klmnop") for _ in range(90))
    encoded = base64.b64encode(pack(body)).decode()
    text = "attached: " + newline.join(encoded[i:i + 76] for i in range(0, len(encoded), 76)) + " end"
    assert [s[0] for s in found(text)][:1] == ["assign"]


def test_secrets_at_the_ends_of_large_layers():
    filler = b"words and words " * (secrets.WINDOW // 16)
    for body in (SECRET + filler * 2, filler + SECRET + filler, filler[:-20] + SECRET + filler, filler * 2 + SECRET):
        text = base64.b64encode(gzip.compress(body)).decode()
        assert [s[0] for s in found(text) if s[2]] == ["assign"]


def test_compressed_several_times():
    data = gzip.compress(bz2.compress(zlib.compress(SECRET)))
    assert [s[0] for s in found(base64.b64encode(base64.b64encode(data)).decode())] == ["assign"]


def test_plain_text_has_no_layers():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 40))) for _ in range(3000)]
    assert secrets.scan_text(" ".join(words))[0] == []


def base_by_force(text):
    """The contract's expressions, one after the other."""
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    rules = [("assign", rf"({name})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
             ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    return sorted(((m.start(), i, m.end()) for i, (_, rule, fits) in enumerate(rules) for m in re.finditer(rule, text or "") if fits(m)))


def test_base_columns_of_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in load(spark, folder, "documents").select("doc_id", "text").collect()}
    kinds = ("assign", "access", "hex")
    for r in queries.op3_secret_scan(spark, folder).collect():
        base = base_by_force(texts[r.doc_id])
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
