"""Text of PDF scripts, from their content streams.

Read are literal and hexadecimal strings of the text operators, in plain or deflated streams; codes are
mapped by a font's ToUnicode table where the file has one for the operators' font, else taken for Latin-1. Encrypted files and
scanned pages have no text here.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
# What escapes stand for.
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return b""
    return m[1]


def _raw(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    unescape = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else _PLAIN.get(m[1], m[1])
    return _ESCAPE.sub(unescape, token[1:-1])


def _table(stream: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and codes to text, of a ToUnicode stream."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    width = 1
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            width = max(width, len(code) // 2)
            out[int(code, 16)] = text(to)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            width = max(width, len(a) // 2)
            for k in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16)):
                out[int(a, 16) + k] = chr(int(to, 16) + k) if len(to) <= 4 else text(to)
    return width, out


def text_of(content: bytes | None) -> str:
    """The text of all content streams in the order of the file; lines end where the text position moves to another one."""
    if not content or not content.startswith(b"%PDF"):
        return ""
    objects = {int(n): body for n, body in _OBJECT.findall(content)}
    tables = {n: _table(s) for n, body in objects.items() if b"begincmap" in (s := _inflated(body))}
    fonts: dict[bytes, tuple[int, dict[int, str]]] = {}
    for body in objects.values():
        for name, number in re.findall(rb"(/[^\s/\[\]()<>]+)\s+(\d+)\s+\d+\s+R", body):
            use = re.search(rb"/ToUnicode\s+(\d+)\s", objects.get(int(number), b""))
            if use and int(use[1]) in tables:
                fonts[name] = tables[int(use[1])]
    lines = [""]
    for body in objects.values():
        stream = _inflated(body)
        if b"BT" in stream and b"begincmap" not in stream:
            _run(stream, fonts, lines)
    return "\n".join(x for x in (re.sub(r"\s+", " ", t).strip() for t in lines) if x)


def _run(stream: bytes, fonts: dict, lines: list[str]) -> None:
    held: list[bytes] = []
    table = None

    def show(raw: bytes) -> str:
        if not table:
            return raw.decode("latin-1")
        width, to = table
        codes = [int.from_bytes(raw[k : k + width], "big") for k in range(0, len(raw), width)]
        return "".join(to.get(c, chr(c) if width == 1 else "") for c in codes)

    for m in _TOKEN.finditer(stream):
        t = m[0]
        if t[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            held.append(t)
            continue
        if t == b"Tf":
            table = next((fonts.get(x) for x in reversed(held) if x[:1] == b"/"), None)
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"'):
                lines.append("")
            for x in held:
                if x[:1] in b"(<":
                    lines[-1] += show(_raw(x))
                elif t == b"TJ" and x[:1] not in b"[]/" and float(x) < -200:  # a gap as wide as a space
                    lines[-1] += " "
        elif t in (b"T*", b"ET"):
            lines.append("")
        elif t in (b"Td", b"TD", b"Tm"):
            numbers = [float(x) for x in held if x[:1] not in b"(<[]/"]
            if numbers and (t == b"Tm" or numbers[-1] != 0):
                lines.append("")
        held.clear()


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the PDF files at path."""
    return texts(spark.read.format("binaryFile").load(path).select("path", "content"), "path", "content")


def texts(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, text of a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(text_of, batch.column(1).to_pylist()), pa.string())], names=[key, "text"])

    return df.select(key, content).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def written(lines: list[str]) -> bytes:
    """A one-page PDF of lines of Latin-1 text, its content deflated."""
    escape = lambda t: re.sub(rb"([()\\])", rb"\\\1", t.encode("latin-1", "replace"))
    body = zlib.compress(b"BT /F1 11 Tf 14 TL 40 800 Td " + b" ".join(b"(" + escape(t) + b") Tj T*" for t in lines) + b" ET")
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>"]
    parts += [b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    out, at = b"%PDF-1.4\n", []
    for k, p in enumerate(parts):
        at.append(len(out))
        out += b"%d 0 obj\n" % (k + 1) + p + b"\nendobj\n"
    table = b"xref\n0 6\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + table + b"trailer\n<< /Size 6 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % len(out)
