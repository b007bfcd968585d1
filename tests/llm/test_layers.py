"""Encoded secrets that repeat in a document, or whose layers are glued, wrapped, joined or partly no text."""

import base64
import bz2
import gzip
import lzma
import random
import time
from urllib.parse import quote

import pytest

from dossier.llm import secrets

KEY = "AKIA" + "Q" * 16
PLAIN = f"my secret='{KEY}' end"


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


def test_repeated_tokens(spark):
    token = b64(PLAIN)
    copies = [token, quote(token, safe=""), b64(quote(PLAIN)), token]
    text = " and ".join(copies)
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = {tuple(s.split(":")) for s in secrets.scan(rows).first().spans.split(",")}
    at, want = 0, set()
    for c in copies:
        want |= {(kind, str(at), str(at + len(c))) for kind in ("assign", "access")}
        at += len(c) + 5
    assert found == want
    assert secrets.redact(rows).first().text == " and ".join(["[secret:assign]"] * 4)


def wrapped(text, width, end="\n"):
    return end.join(text[i : i + width] for i in range(0, len(text), width))


FILL = "".join(chr(97 + i * i * 7 % 26) + " " * (i % 5 == 0) for i in range(90))
SECRET = (FILL + f"token={KEY}").encode()
LAYERS = {
    "slash": "path/" + b64(PLAIN),
    "underscore": "id_" + b64(PLAIN),
    "dash": "x-" + b64(PLAIN),
    "plus": "ab+" + b64(PLAIN),
    "letters": "abc" + b64(PLAIN),
    "end": b64(PLAIN).rstrip("=") + "/rest/of",
    "glued gzip": "x-" + b64(gzip.compress(SECRET, mtime=0)),
    "wrapped": wrapped(b64(SECRET), 64),
    "wrapped at 7": wrapped(b64(SECRET), 7, "\r\n"),
    "wrapped gzip": wrapped(b64(gzip.compress(SECRET, mtime=0)), 20),
    "gzip members": b64(gzip.compress(FILL.encode(), mtime=0) + gzip.compress(SECRET, mtime=0)),
    "bzip2 members": b64(bz2.compress(FILL.encode()) + bz2.compress(SECRET)),
    "xz members": b64(lzma.compress(FILL.encode()) + lzma.compress(SECRET)),
    "control bytes": b64(b"\x00\x01 token=" + KEY.encode() + b"\xff end"),
    "percent": "%ff" + "".join(f"%{c:02x}" for c in f"token={KEY}".encode()),
    "percent gzip": quote(gzip.compress(SECRET, mtime=0), safe=""),
}


@pytest.mark.parametrize("name", LAYERS)
def test_layer(name):
    token = LAYERS[name]
    found = secrets.spans(f"é start {token} end")[1]
    assert {k for k, *_ in found} == {"access", "assign"}
    assert all(8 <= a < b <= 8 + len(token) for _, a, b in found)
    # nothing is left to find, and what is glued before a token stays
    left = secrets.mask(f"é start {token} end")
    assert secrets.spans(left.replace("[secret:assign]", " ").replace("[secret:access]", " "))[1] == [] and left.startswith("é start ") and left.endswith(" end")
    if name in ("slash", "underscore", "dash", "plus", "glued gzip"):
        assert left == f"é start {token[: token.find(next(c for c in '/_-+' if c in token[:5])) + 1]}[secret:assign] end"


def test_other_words_stay():
    text = "path/internationalization_and-localization\nconsiderations\nregarding %e4%f6 " + b64(bytes(range(256)) * 40)
    assert secrets.spans(text) == ([], []) and secrets.mask(text) == text


def test_warc_query_reads_record_bytes(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from dossier.llm import warc
    from dossier.llm.queries import QUERIES

    long = "<p>é" + "y" * 200
    rows = [(3, "u3", long), (1, "u1", long), (2, "u2", None), (4, "u\r\n4", "short"), (None, None, "q" * 100)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in QUERIES["op8_warc"](spark, str(tmp_path)).collect()}
    assert got == {(1, 205, "response", None), (3, 205, "revisit", 1), (2, 0, "response", None), (4, 5, "response", None), (None, 100, "response", None)}
    header = warc._header()
    for wrong in (("WARC-Payload-Digest: sha256:.", "WARC-Payload-Digest: sha256:x"), ("msgtype=response\r\nContent-Length: ", "msgtype=response\r\nContent-Length: 1")):
        monkeypatch.setattr(warc, "_header", lambda w=wrong: F.regexp_replace(header, *w))
        with pytest.raises(Exception, match="Content-Length|match its header"):
            QUERIES["op8_warc"](spark, str(tmp_path)).collect()


def words(n, seed=3):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n // 7)).encode()


@pytest.mark.parametrize("before", [100, 700_000, 900_000, 1_040_000, 2_100_000])
@pytest.mark.parametrize("kind", ["token", "wrapped", "raw"])
def test_tokens_over_window_borders(before, kind):
    """Nested tokens and streams that lie over the border of a window of decompressed data are read whole, wherever the border is."""
    inner = gzip.compress(random.Random(1).randbytes(320_000) + f" token={KEY}".encode(), mtime=0)
    token = base64.b64encode(inner)
    part = {"token": token, "wrapped": b"\n".join(token[i : i + 76] for i in range(0, len(token), 76)), "raw": b"\x00" + inner}[kind]
    text = "see " + b64(gzip.compress(words(before) + b" : " + part + b" : " + words(300_000), mtime=0))
    assert [s for s in secrets.spans(text)[1] if s[0] == "access"] == [("access", 4, len(text))]


@pytest.mark.parametrize("data", [b"\x1f\x8b\x08" * 350_000, b"x\x9c" * 500_000, b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03" + (b"\x00\x0a\x00\xf5\xff" + b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03") * 60_000, b"BZh91AY&SY" * 100_000, bytes(random.Random(4).randbytes(1_000_000))], ids=["gzip", "zlib", "stored", "bzip2", "random"])
def test_marks_take_linear_time(data):
    """A megabyte of marks of compressed data is passed over quickly; a key behind it is found."""
    start = time.process_time()
    found = secrets.spans(b64(data) + " " + KEY)[1]
    assert ("access", len(b64(data)) + 1, len(b64(data)) + 1 + len(KEY)) in found
    assert time.process_time() - start < 15


def test_broken_streams_keep_what_comes_before():
    for squeeze in (lambda x: gzip.compress(x, mtime=0), bz2.compress, lzma.compress):
        good = squeeze(SECRET + words(3000))
        cut, long = squeeze(SECRET + words(900_000)), squeeze(words(400_000) + SECRET + words(500_000))
        for data in (good + b"tail that is no stream", cut[: len(cut) // 2] if squeeze is not bz2.compress else good, long):
            assert ("access", 0, len(b64(data))) in secrets.spans(b64(data))[1]
