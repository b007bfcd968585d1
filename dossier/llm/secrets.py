"""Secret scans with a recursive decoding worklist: nested URL, Unicode, base64 and compressed layers."""

from __future__ import annotations

import binascii
import bisect
import bz2
import contextlib
import functools
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = re.compile(r"(?ai)passw|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: Escapes of an escape's own sign, more than once: %25..., &#38;#38;... and \\x5cx5c... are peeled at once, not level by level.
_NESTED = re.compile(r"%(?:25){2,}(?=[0-9A-Fa-f]{2})|&(?:#38;|#[xX]26;){2,}(?=#)|\\(?:x5[cC]|u005[cC]){2,}(?=[xu])")
#: Bytes of decompressed data that are read at a time; a window grows to the end of the tokens and streams that are open where it ends, up
#: to HELD bytes. Only what is open for longer is parted, with OVERLAP bytes of the part before.
WINDOW, HELD, OVERLAP = 1 << 20, 32 << 20, 1 << 16
#: Bytes that a decompressor gets at first, as most likenesses break at once, and at most.
FIRST, CHUNK = 64, 1 << 16
#: Streams that are broken or cut may hide others: their bytes are read again from each mark within, REREAD times the layer's size in all.
#: After that, marks within what a stream has read are passed over.
REREAD = 8
_LETTER = "[A-Za-z0-9+/_-]"
_BASE64 = re.compile(_LETTER + r"{16,}={0,2}")
_BREAK = re.compile(rf"(?<={_LETTER})[ \t]*\r?\n[ \t]*(?={_LETTER})")
_RUN = re.compile(_LETTER + "+={0,2}")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_AFTER = re.compile("(?<=[+/_-])(?=[A-Za-z0-9+/_-]{16})")
_STANDARD = bytes.maketrans(b"-_", b"+/")
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
# bytes without any of these hold neither a secret nor a further layer: most words of prose end here
_HINT = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9xX][0-9A-Fa-f]{0,6};|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]|" + _MAGIC.pattern)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand in the text as it is; leftmost and without overlap in a kind."""
    out = []
    if _WORDS.search(text):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


class _Layer:
    """A text and, for each of its characters, the span of the document it comes from."""

    def __init__(self, text: str, starts, ends):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return min(self.starts[a:b]), max(self.ends[a:b])

    def key(self) -> bytes:
        """A digest of the text and of where in the document it comes from."""
        whole = hashlib.blake2b(_bytes(self.text), digest_size=20)
        for x in (self.starts, self.ends):
            whole.update(x.tobytes() if isinstance(x, array) else repr(x).encode())
        return whole.digest()


def _escaped(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with every escape of a pattern decoded, character by character."""
    text, starts, ends, at = [], array("q"), array("q"), 0
    flat = isinstance(layer.starts, int)
    for m in pattern.finditer(layer.text):
        got = decode(m)
        if got is None:
            continue
        text.append(layer.text[at : m.start()]), text.append(got)
        if flat:
            at = m.end()
            continue
        for i in range(at, m.start()):
            a, b = layer.span(i, i + 1)
            starts.append(a), ends.append(b)
        a, b = layer.span(*m.span())
        starts.extend([a] * len(got))
        ends.extend([b] * len(got))
        at = m.end()
    if not at:
        return None
    text.append(layer.text[at:])
    if flat:
        return _Layer("".join(text), layer.starts, layer.ends)
    for i in range(at, len(layer.text)):
        a, b = layer.span(i, i + 1)
        starts.append(a), ends.append(b)
    return _Layer("".join(text), starts, ends)


def _text(data: bytes) -> str:
    """Bytes as text; those that aren't UTF-8 stay as surrogates, so _bytes gives the same bytes again."""
    return data.decode("utf-8", "surrogateescape")


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def _percent(m: re.Match) -> str:
    return _text(bytes.fromhex(m[0].replace("%", "")))


def _character(m: re.Match) -> str | None:
    n = int(m[1] or m[2] or m[4], 16) if m[3] is None else int(m[3])
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else None


class _Marks:
    """Where compressed data may start in a layer's bytes. Headers are read here, so that most likenesses need no decompressor."""

    def __init__(self, data: bytes):
        self.data, self.zero = data, (0, -1)

    def _past_zero(self, at: int) -> int:
        """The place after the next zero byte, 0 if there is none; a search isn't made twice."""
        asked, found = self.zero
        if not asked <= at <= found and not (found == len(self.data) and at >= asked):
            found = self.data.find(b"\0", at)
            self.zero = at, found = at, found if found >= 0 else len(self.data)
        return found + 1 if found < len(self.data) else 0

    def _block(self, at: int) -> bool:
        """Whether a deflate block may start here."""
        kind = self.data[at] >> 1 & 3 if at < len(self.data) else 3
        stored = self.data[at + 1 : at + 5]
        return kind in (1, 2) or (kind == 0 and all(p ^ q == 255 for p, q in zip(stored[:2], stored[2:], strict=False)))

    def decompressor(self, at: int):
        """What inflates the gzip, zlib, bzip2 or xz data that starts at a place; None for other data."""
        head = self.data[at : at + 12]
        if head[:3] == b"\x1f\x8b\x08" and len(head) > 10 and not head[3] & 0xE0:
            body = at + 10
            if head[3] & 4:
                body += 2 + int.from_bytes(self.data[body : body + 2], "little")
            for flag in (8, 16):
                if head[3] & flag and not (body := self._past_zero(body)):
                    return None
            return zlib.decompressobj(31) if self._block(body + (head[3] & 2)) else None
        if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0 and not head[1] & 0x20:
            return zlib.decompressobj(15) if self._block(at + 2) else None
        if head[:3] == b"BZh" and head[4:10] in (b"1AY&SY", b"\x17rE8P\x90"):
            return bz2.BZ2Decompressor()
        return lzma.LZMADecompressor() if head[:6] == b"\xfd7zXZ\x00" else None

    def inflated(self, at: int) -> Iterator[tuple[bytes, int, str]]:
        """(content, place up to which data has been read, state) of the members that start at a place, one after another. The state is
        more, done at a member's end, or broken; what comes before a broken place counts."""
        data = memoryview(self.data)
        while (d := self.decompressor(at)) is not None:
            start, size, before = at, FIRST, 0
            while not d.eof and at < len(data):
                part, saved, told = data[at : at + size], d.copy() if hasattr(d, "copy") else None, 0
                at, size = at + len(part), min(CHUNK, 8 * size)
                try:
                    for got in _fed(d, part):
                        told += len(got)
                        yield got, at, "more"
                except _BROKEN:
                    slow = _slowly(saved, part, told) if saved else _slowly(self.decompressor(start), data[start:at], before + told)
                    yield from ((got, at, "broken") for got in slow)
                    yield b"", at, "broken"
                    return
                before += told
                yield b"", at, "more"
            if not d.eof:
                return
            at -= len(d.unused_data)
            yield b"", at, "done"


_BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError)


def _fed(d, part) -> Iterator[bytes]:
    """The content that a decompressor gives for a part of its data, WINDOW bytes at a time."""
    while True:
        got = d.decompress(part, WINDOW)
        if got:
            yield got
        part = getattr(d, "unconsumed_tail", b"")
        if d.eof or getattr(d, "needs_input", not part and len(got) < WINDOW):
            return


def _slowly(d, data, told: int) -> Iterator[bytes]:
    """The content up to the place where data breaks, beyond told bytes of it that are known."""
    with contextlib.suppress(*_BROKEN):
        for i in range(0, len(data), 16):
            for got in _fed(d, data[i : i + 16]):
                if len(got) > told:
                    yield got[told:]
                told = max(0, told - len(got))


_BLANKS = re.compile(rb"(?<![\r\n \t])[ \t]+(?=[^\r\n \t])")
_OTHER = re.compile(rb"[^A-Za-z0-9+/_=%\\&#;\r\n \t-]")


def _open(data: bytes) -> int:
    """Where what is still open at the end of data starts: a run of escapes or base64, over line ends too, or a compressed stream."""
    at = len(data)
    while at and _OTHER.search(data, max(0, at - 4096), at) is None:
        at = max(0, at - 4096)
    low = max(0, at - 4096)
    for m in _OTHER.finditer(data, low, at):
        low = m.end()
    at = max([low, *(m.end() for m in _BLANKS.finditer(data, low))])
    marks, look, spent = _Marks(data), 0, 0
    while (m := _MAGIC.search(data, look, at)) is not None:
        end, state = m.start(), "broken"
        for _, end, state in marks.inflated(m.start()):
            pass
        if state == "more":
            return m.start()
        spent += end - m.start()
        look = max(m.start() + 1, end if state == "done" or spent > REREAD * len(data) + WINDOW else 0)
    return at


def _windows(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Contents as windows: each ends where the next one begins, or further; what is open at its end comes whole in the next."""
    held, fresh, most = b"", False, WINDOW
    for part in parts:
        held, fresh = held + part, fresh or bool(part)
        if len(held) >= most:
            yield held
            start = min(_open(held), len(held) - min(len(held), OVERLAP))
            held, fresh = held[start if len(held) - start <= HELD else len(held) - OVERLAP :], False
            most = max(WINDOW, 2 * len(held))
    if fresh:
        yield held


def _streams(layer: _Layer) -> Iterator[_Layer]:
    """The contents of compressed data anywhere in a layer, each mapped to the place of its data."""
    data, at, spent = _bytes(layer.text), 0, 0
    marks = _Marks(data)
    while (m := _MAGIC.search(data, at)) is not None:
        first, some, end, state = [], 0, m.start(), "broken"
        for got, end, state in marks.inflated(m.start()):
            some += len(got)
            if some <= WINDOW:
                first.append(got)
        spent += end - m.start()
        if some:
            a = len(_text(data[: m.start()])) if layer.starts is None or not isinstance(layer.starts, int) else 0
            span = layer.span(a, max(a + 1, min(len(layer.text), a + len(_text(data[m.start() : end])))))
            # longer contents are inflated once more now that their end is known, and aren't held whole
            for inner in [b"".join(first)] if some <= WINDOW else _windows(got for got, _, _ in marks.inflated(m.start())):
                if _HINT.search(inner):
                    yield _Layer(_text(inner), *span)
        # broken or cut data may be a chance likeness with a true stream behind it
        at = max(m.start() + 1, end if state == "done" or spent > REREAD * len(data) + WINDOW else 0)


def _phases(run: str) -> list[tuple[int, bytes]]:
    """(characters left out, bytes) of a base64 run read from each of its first four characters, where the bytes hold something."""
    body, out = run.rstrip("=").encode().translate(_STANDARD), []
    for p in range(min(4, len(body))):
        part = body[p:]
        part = part[:-1] if len(part) % 4 == 1 else part
        data = binascii.a2b_base64(part + b"=" * (-len(part) % 4))
        if _HINT.search(data):
            out.append((p, data))
    return out


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\udc80-\udcff]")


def _last_odd(data: bytes) -> int:
    """The place after the last byte that isn't text."""
    text, at = _text(data), 0
    for m in _CONTROL.finditer(text):
        at = m.end()
    return len(_bytes(text[:at]))


def _tokens(run: str) -> list[tuple[int, str]]:
    """(start, text) of the layers of a base64 run. What is glued before a token by / _ - or + is left out where the rest is
    text or compressed data; else a layer stands for the whole run."""
    out = []
    for p, data in _phases(run):
        odd, marks = _last_odd(data), _Marks(data)
        for a in [0] * (p == 0) + [x.start() for x in _AFTER.finditer(run) if x.start() % 4 == p]:
            at = (a - p) // 4 * 3
            whole = any(got for got, _, _ in marks.inflated(at)) if _MAGIC.match(data, at) else at >= odd and data[at : at + 1] and not 0x80 <= data[at] < 0xC0
            if whole:
                out.append((a, _text(data[at:])))
                if p or a:
                    out.append((0, _text(data[:at])))
                break
        else:
            out.append((0, _text(data)))
    return [(a, t) for a, t in out if t]


def _wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """(start, end) of the lines of each base64 block that goes over line ends."""
    lines: list[tuple[int, int]] = []
    for m in _BREAK.finditer(text):
        if not lines or lines[-1][1] != m.start():
            if len(lines) > 1:
                yield lines
            a = m.start()
            while a and text[a - 1] in _LETTERS:
                a -= 1
            lines = [(a, m.start())]
        lines.append(_RUN.match(text, m.end()).span())
    if len(lines) > 1:
        yield lines


def _unwrapped(layer: _Layer) -> Iterator[_Layer]:
    """The layers of base64 blocks whose tokens go over line ends: characters map to the lines they come from."""
    for lines in _wrapped(layer.text):
        if sum(b - a for a, b in lines) < 16:
            continue
        spans = [layer.span(*x) for x in lines]
        ends = list(itertools.accumulate(b - a for a, b in lines))
        for p, data in _phases("".join(layer.text[a:b] for a, b in lines)):
            if isinstance(layer.starts, int):
                yield _Layer(_text(data), layer.starts, layer.ends)
                continue
            text, at, first, last = _text(data), 0, array("q"), array("q")
            for c in text:
                n = len(_bytes(c))
                first.append(spans[bisect.bisect_right(ends, min(p + at * 4 // 3, ends[-1] - 1))][0])
                last.append(spans[bisect.bisect_right(ends, min(p + (8 * (at + n) - 1) // 6, ends[-1] - 1))][1])
                at += n
            yield _Layer(text, first, last)


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, each by start, then kind, then end.

    Layers wait in a worklist until none is new: a layer whose text was seen at the same place of the document is not
    entered again, so quines and loops end, and a token that stands twice is found twice. What is found in a layer is mapped
    to the span of the document that it was decoded from; a base64 or compressed layer maps to its whole token, a base64
    block over several lines to the lines that hold the secret. Base64 is read at all four alignments; bytes that aren't
    text stay in their layer as they are. Base spans stay; a span found twice counts once.
    """
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    found, seen, work = set(base), {_Layer(text, None, None).key()}, [_Layer(text, None, None)]
    tokens, plain = functools.cache(_tokens), functools.cache(base_spans)
    while work:
        layer = work.pop()
        inner = []
        if (peeled := _escaped(layer, _NESTED, lambda m: m[0][0])) is not None:
            inner.append(peeled)
        else:
            if "%" in layer.text:
                inner.append(_escaped(layer, _URL, _percent))
            if "\\" in layer.text or "&#" in layer.text:
                inner.append(_escaped(layer, _UNICODE, _character))
        for m in _BASE64.finditer(layer.text):
            inner += [_Layer(got, *layer.span(m.start() + a, m.end())) for a, got in tokens(m[0])]
        if "\n" in layer.text:
            inner += _unwrapped(layer)
        if layer.starts is not None:
            inner += _streams(layer)
        for new in inner:
            if new is not None and (key := new.key()) not in seen:
                seen.add(key)
                found.update((k, *new.span(a, b)) for k, a, b in plain(new.text))
                work.append(new)
    return base, sorted(found, key=order)


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _scanned(batches: Iterator):
    import pyarrow as pa

    for whole in batches:
        for batch in pieces(whole):
            rows = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in batch.column("text"):
                base, every = spans(text.as_py() or "")
                for k in KINDS:
                    rows[f"n_{k}"].append(sum(s[0] == k for s in base))
                rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows["spans"].append(joined(every))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in rows.items()})


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null texts count as empty (no spans, the digest of the empty string). Repeated rows keep one row each; null ids stay
    null. Other columns are ignored. Offsets are code points, ends exclusive.
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str | None) -> str | None:
    """The text with every secret span replaced by [secret:kind]; overlapping spans are replaced together."""
    if not text:
        return text
    out, at = [], 0
    found = spans(text)[1]
    while found:
        kind, a, b = found.pop(0)
        while found and found[0][1] < b:
            b = max(b, found.pop(0)[2])
        out.append(text[at:a] + f"[secret:{kind}]")
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text masked (and n_chars, where there is one, counted again); all rows stay."""
    schema = docs.schema

    def masked(batches: Iterator):
        import pyarrow as pa

        for whole in batches:
            for batch in pieces(whole):
                text = pa.array([mask(x.as_py()) for x in batch.column("text")], pa.string())
                yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    lean(docs.sparkSession)
    out = docs.mapInArrow(masked, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
