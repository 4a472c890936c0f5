"""Text of PDF files, as far as their streams show it, and PDF pages from pins."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from unitloom.operators.documents import PAGE_HEIGHT, PAGE_WIDTH

_STREAM = re.compile(rb"<<(?P<dict>(?:[^<>]|<<[^<>]*>>|<[0-9A-Fa-f\s]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return raw.decode("utf-16-be", "replace") if raw[:1] == b"\0" and len(raw) % 2 == 0 else raw.decode("cp1252", "replace")

    def escaped(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r\n") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escaped, token[1:-1], flags=re.S).decode("cp1252", "replace")


def extract(data: bytes) -> tuple[str, list[str]]:
    """Text in stream order and what may be missing from it. Lines end where the text position moves down; a wide step
    within a line is a space."""
    caveats, parts = [], []
    if b"/Encrypt" in data:
        return "", ["the file is encrypted"]
    for found in _STREAM.finditer(data):
        head, body = found["dict"], found["body"]
        if b"/Image" in head or b"/FontFile" in head:
            continue
        if b"/Filter" in head:
            if b"/FlateDecode" not in head:
                caveats.append("a stream has a filter that is not read")
                continue
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                caveats.append("a stream is damaged")
                continue
        if b"BT" not in body:
            continue
        stack: list[bytes] = []
        text: list[str] = []
        for m in _TOKEN.finditer(body):
            token = m[0]
            if token[:1] in b"(<[]" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
                stack.append(token)
                continue
            if token in (b"Tj", b"'", b'"') and stack:
                text.append(("\n" if token != b"Tj" else "") + _string(stack[-1]))
            elif token == b"TJ":
                for x in stack:
                    if x[:1] in b"(<":
                        text.append(_string(x))
                    elif x not in (b"[", b"]") and float(x) < -200:
                        text.append(" ")
            elif token in (b"T*", b"ET", b"BT") or token in (b"Td", b"TD") and len(stack) > 1 and float(stack[-1]) != 0 or token == b"Tm":
                text.append("\n")
            stack.clear()
        parts.append("".join(text))
    whole = "\n".join(" ".join(line.split()) for line in "\n".join(parts).split("\n"))
    whole = re.sub(r"\n{2,}", "\n", whole).strip("\n")
    if not whole:
        caveats.append("no text was found; the pages may be images")
    return whole, caveats


def read_pdf(files: DataFrame) -> DataFrame:
    """``file``, ``text``, ``caveats`` of rows ``file``, ``content``."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(f, *extract(bytes(c))) for f, c in frame.itertuples(index=False)], columns=["file", "text", "caveats"])

    return files.select("file", "content").mapInPandas(of, "file string, text string, caveats array<string>")


def render(pins: list[dict]) -> bytes:
    """A PDF of placed lines in the standard fonts."""
    fonts = sorted({p["font"] for p in pins} | {"Courier"})
    pages = max((p["page"] for p in pins), default=0) + 1
    objects: list[bytes] = []
    first_page = 3 + len(fonts)
    kids = " ".join(f"{first_page + 2 * i} 0 R" for i in range(pages))
    objects.append(b"<< /Type /Catalog /Pages 2 0 R >>")
    objects.append(f"<< /Type /Pages /Kids [{kids}] /Count {pages} >>".encode())
    objects += [f"<< /Type /Font /Subtype /Type1 /BaseFont /{f} /Encoding /WinAnsiEncoding >>".encode() for f in fonts]
    resources = " ".join(f"/F{i} {3 + i} 0 R" for i in range(len(fonts)))
    for page in range(pages):
        lines = []
        for p in (p for p in pins if p["page"] == page):
            text = p["text"].encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            place = f"BT /F{fonts.index(p['font'])} {p['size']:g} Tf 1 0 0 1 {p['x']:g} {PAGE_HEIGHT - p['y'] - p['size']:g} Tm ("
            lines.append(place.encode() + text + b") Tj ET")
        body = zlib.compress(b"\n".join(lines))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE_WIDTH:g} {PAGE_HEIGHT:g}] /Resources << /Font << {resources} >> >> /Contents {first_page + 2 * page + 1} 0 R >>".encode())
        objects.append(f"<< /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream")
    out, offsets = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n", []
    for i, o in enumerate(objects, 1):
        offsets.append(len(out))
        out += f"{i} 0 obj\n".encode() + o + b"\nendobj\n"
    start = len(out)
    table = "".join(f"{o:010d} 00000 n \n" for o in offsets)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()


def to_pdf(pins: DataFrame, key: str) -> DataFrame:
    """``content`` for every document; its pins come together."""
    kind = dict(pins.dtypes)[key]

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(rows[key].iloc[0], render(rows.sort_values(["page", "y", "x"]).to_dict("records")))], columns=[key, "content"])

    return pins.groupBy(key).applyInPandas(of, f"`{key}` {kind}, content binary")
