"""Secret scans that unwrap nested encodings until nothing new appears.

A text is the first layer of a worklist. Each layer is scanned for secrets. A layer with URL or
Unicode escapes gives one in which all of them are decoded in place, so that values stay with
the names before them (bytes that are not UTF-8 stay escaped); texts in what a base64 stretch decodes to, plain
or unpacked from gzip, zlib, bzip2, xz or zstandard data, become layers of their own,
and so on until no layer yields a new one. A layer that has been seen before, for the same place, is not scanned
again, which also ends cycles. Every character of a layer remembers the code points of the
original text that it came from, so matches in any layer map back to spans.

Kinds of secrets: ``assign`` (a name such as ``password`` or ``api_key``, a separator and a
value of 6 characters or more), ``access`` (an access key id of 20 or more), ``hex`` (24 or
more lower-case hexadecimal digits). Matches are leftmost and do not overlap within a kind;
one that is too short is dropped.

A base64 stretch is decoded in all four alignments, so a path or a name before it does no
harm, and lines of 40 or more characters are joined. Compressed data, all members or frames of
it, is scanned in windows of ``WINDOW`` bytes that overlap by ``OVERLAP``, however much it
expands to; what is encoded once more across the end of a window is found if it is shorter
than the overlap.

Cases: null and empty texts have no spans; a span found both plainly and in a layer is given
once, as the plain one; repeated rows give repeated rows; an empty table gives none; only
the named columns are read, so others may clash.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep.llm.common import in_small_batches

WINDOW = 8 << 20  # bytes of unpacked data scanned at once; neighbouring windows share OVERLAP
OVERLAP = 1 << 20
KINDS = ("assign", "access", "hex")

# letters in either case, but ASCII letters only
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)
                  for name in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMED = re.compile(r"passw(?:or)?d|secret|token|api_?key")

UNIT = {"url": re.compile(r"(?:%[0-9A-Fa-f]{2})+"), "unicode": re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")}
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{40,}\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]+={0,2}")
#: Text of at least twelve bytes, and the first bytes of compressed data, within decoded data.
RUN = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){6,}")
LEAST_RUN = 12
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of one layer."""
    found = []
    if NAMED.search(text.lower()):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a maximal run is long enough as a whole or nowhere
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def unpacked(data: bytes) -> Iterator[bytes]:
    """Plain bytes of compressed data, piece by piece, of all its members or frames; stops where it is broken."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        try:
            reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
            while piece := reader.read(1 << 20):
                yield piece
        except zstandard.ZstdError:
            pass
        return
    while data:
        if data[:2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(31)
        elif data[:1] == b"\x78":
            unpack = zlib.decompressobj()
        elif data[:3] == b"BZh":
            unpack = bz2.BZ2Decompressor()
        elif data[:6] == b"\xfd7zXZ\x00":
            unpack = lzma.LZMADecompressor()
        else:
            return
        try:
            while not unpack.eof:
                piece = unpack.decompress(data, 1 << 20)
                data = getattr(unpack, "unconsumed_tail", b"")  # the other kinds keep what is left themselves
                if not piece and not data:
                    break
                yield piece
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return
        data = unpack.unused_data if unpack.eof else b""


def windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces gathered into windows that overlap."""
    held, fresh = b"", False
    for piece in pieces:
        held, fresh = held + piece, True
        if len(held) >= WINDOW:
            yield held
            held, fresh = held[-OVERLAP:], False
    if fresh:
        yield held


def texts_in(data: bytes) -> Iterator[tuple[int, str]]:
    """Stretches of text in bytes, and where they begin."""
    for m in RUN.finditer(data):
        if m.end() - m.start() >= LEAST_RUN:
            try:
                yield m.start(), m[0].decode()
            except UnicodeDecodeError:  # surrogates and the like
                continue


def unpacked_texts(data: bytes) -> Iterator[str]:
    """Texts in compressed data, also if it was compressed several times."""
    for i, plain in enumerate(windows(unpacked(data))):
        if i == 0 and PACKED.match(plain):
            yield from unpacked_texts(plain)
        for _, text in texts_in(plain):
            yield text


def unescape(layer: str, at: list[tuple[int, int]], kind: str):
    """Decode the escapes of a layer in place; ``at`` has the origin of each of its characters."""
    text, places, upto = [], [], 0
    for m in UNIT[kind].finditer(layer):
        if kind == "url":
            data, codec = binascii.unhexlify(m[0].replace("%", "")), "utf-8"
        else:
            data, codec = b"".join(int(h, 16).to_bytes(2, "big") for h in m[0].split("\\u")[1:]), "utf-16-be"
        text.append(layer[upto:m.start()])
        places += at[upto:m.start()]
        done, width = 0, 3  # characters of an escape for each byte, in either kind
        while done < len(data):
            try:
                good = bad = len(data)
                decoded = data[done:].decode(codec)
            except UnicodeDecodeError as error:
                # what cannot be decoded stays as it is, and the run goes on after it
                good, bad = done + error.start, done + error.end
                decoded = data[done:good].decode(codec)
            i = m.start() + done * width
            for c in decoded:
                size = len(c.encode(codec)) * width
                places.append((at[i][0], at[i + size - 1][1]))
                i += size
            text += [decoded, layer[i:m.start() + bad * width]]
            places += at[i:m.start() + bad * width]
            done = bad
        upto = m.end()
    text.append(layer[upto:])
    return "".join(text), places + at[upto:]


def unbase64(stretch: str, origin) -> Iterator[tuple[str, list]]:
    """Texts, plain or compressed, anywhere in a base64 stretch, and the origin of their characters.

    A path, a prefix or a name may stand in front, so all four alignments are decoded, and
    text and the first bytes of compressed data are looked for at any place. ``origin`` gives the
    origins of the characters of the stretch.
    """
    body, at = _standard(stretch.rstrip("=")), None
    decoded = []
    for shift in range(4):
        usable = len(body) - shift
        usable -= usable % 4 == 1
        if usable >= 16:
            decoded.append((shift, base64.b64decode(body[shift:shift + usable] + "=" * (-usable % 4))))
    for shift, data in decoded:
        for m in PACKED.finditer(data):
            packed = False
            for text in unpacked_texts(data[m.start():]):
                at, packed = at or origin(), True
                whole = (at[shift + m.start() * 4 // 3][0], at[-1][1])
                yield text, [whole] * len(text)
            if packed:  # all else from here on is packed data, and in the other alignments noise
                decoded = [(shift, data[:m.start()])]
                break
        if len(decoded) == 1:
            break
    for shift, data in decoded:
        for start, text in texts_in(data):
            at = at or origin()
            places, i = [], start
            for c in text:
                size = len(c.encode())
                places.append((at[shift + i * 4 // 3][0], at[min(shift + (i + size) * 4 // 3, len(body) - 1)][1]))
                i += size
            yield text, places


def layers_of(text: str, at) -> Iterator[tuple[str, list]]:
    """Decoded layers of a layer; ``at`` is None for the original."""
    def origin(a: int, b: int) -> list[tuple[int, int]]:
        return [(i, i + 1) for i in range(a, b)] if at is None else at[a:b]

    for kind, mark in (("url", "%"), ("unicode", "\\u")):
        if mark in text and UNIT[kind].search(text):
            layer = unescape(text, origin(0, len(text)), kind)
            if layer[0] != text:
                yield layer
    for m in BASE64.finditer(text):
        yield from unbase64(m[0], lambda m=m: origin(*m.span()))
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            kept = [i for i, c in enumerate(m[0]) if not c.isspace()]

            def unwrapped(m=m, kept=kept):
                whole = origin(*m.span())
                return [whole[i] for i in kept]

            yield from unbase64("".join(m[0].split()), unwrapped)


def _standard(body: str) -> str:
    return body.replace("-", "+").replace("_", "/")


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int, int]], int]:
    """Sorted ``(start, kind number, end, depth)``, and the number of layers."""
    text = text or ""
    spans = {(start, KINDS.index(kind), end): 0 for kind, start, end in base_matches(text)}
    plain = dict.fromkeys(spans)
    seen = set()
    todo = deque((layers_of(text, None), 1) for _ in range(1))
    while todo:
        layers, depth = todo.popleft()  # the least deep first: what is met again is not scanned
        for body, at in layers:
            key = (hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).digest(), at[0][0], at[-1][1])
            if key in seen:
                continue
            seen.add(key)
            for kind, a, b in base_matches(body):
                number, start, end = KINDS.index(kind), at[a][0], at[b - 1][1]
                if not any(k == number and s <= start and end <= e for s, k, e in plain):
                    spans.setdefault((start, number, end), depth)
            todo.append((layers_of(body, at), depth + 1))
    return sorted((*span, depth) for span, depth in spans.items()), len(seen)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, spans, n_layers``; a span has ``kind, start, end, depth`` (0: plain)."""
    import pyarrow as pa

    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int64())])

    def run(batches):
        for batch in batches:
            found = [scan_text(t) for t in batch.column(1).to_pylist()]
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "depth": d} for s, k, e, d in f[0]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(span)), pa.array([f[1] for f in found], pa.int64())],
                names=[id_col, "spans", "n_layers"])

    kind = T.StructType([T.StructField("kind", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("start", "end", "depth")])
    return in_small_batches(docs.select(id_col, F.col(text).alias("_text"))).mapInArrow(run, T.StructType([
        docs.schema[id_col], T.StructField("spans", T.ArrayType(kind)),
        T.StructField("n_layers", T.LongType())]))
