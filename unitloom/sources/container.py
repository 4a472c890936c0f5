"""A binary container of typed chunks: a fixed header with the hash of its body, then records of type, length and value.

Chunks nest: the value of a list chunk is a sequence of records itself. A value starts with its codec (0 stored, 1 zstd)
and key slot (0 none). SHA-256 is the hash, so files of other writers are read only with ``verify`` off.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"ULM1"
HEADER = struct.Struct("<4s2sBBIQQ32s")
RECORD = struct.Struct("<4sQ")
STORED, ZSTD = 0, 1
COMPRESS_FROM = 256
#: Children of this size or more compress well alone and stay readable alone.
ALONE_FROM = 4096
LISTS = ("DATA", "SUMM")
SHAPE = "file string, path string, parent string, pos int, type string, codec int, slot int, offset long, size long, value binary"


class ContainerError(ValueError):
    """Bytes that are cut off, damaged or of another kind."""


@dataclass
class Chunk:
    type: str
    value: bytes = b""
    children: list[Chunk] = field(default_factory=list)
    slot: int = 0

    @property
    def nested(self) -> bool:
        return self.type in LISTS


@dataclass(frozen=True)
class Header:
    tag: str
    version: tuple[int, int]
    flags: int
    offset: int
    length: int
    digest: bytes


def _record(kind: str, body: bytes) -> bytes:
    return RECORD.pack(kind.encode("ascii"), len(body)) + body


def _value(raw: bytes, slot: int, compress: bool) -> bytes:
    packed = zstandard.ZstdCompressor(level=12).compress(raw) if compress and len(raw) >= COMPRESS_FROM else raw
    codec = ZSTD if len(packed) < len(raw) else STORED
    return bytes([codec, slot]) + (packed if codec else raw)


def encode(chunks: list[Chunk], compress: bool = True) -> bytes:
    """Records of all chunks. Small children of a list are compressed together, large ones each."""
    out = b""
    for c in chunks:
        if c.nested:
            apart = any(len(x.value) >= ALONE_FROM or x.nested for x in c.children)
            out += _record(c.type, _value(encode(c.children, compress and apart), c.slot, compress and not apart))
        else:
            out += _record(c.type, c.value if c.slot and c.value[:1] else _value(c.value, c.slot, compress))
    return out


def pack(tag: str, chunks: list[Chunk], flags: int = 0, magic: bytes = MAGIC) -> bytes:
    body = encode(chunks)
    return HEADER.pack(magic, tag.encode("ascii"), 1, 0, flags, HEADER.size, len(body), hashlib.sha256(body).digest()) + body


def write(path: str, tag: str, chunks: list[Chunk], overwrite: bool = False) -> None:
    """Whole or not at all: to a temporary file beside the target, flushed, then renamed."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "wb") as f:
        f.write(pack(tag, chunks))
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def header(data: bytes, magic: bytes = MAGIC) -> Header:
    if len(data) < HEADER.size:
        raise ContainerError("the header is cut off")
    found, tag, major, minor, flags, offset, length, digest = HEADER.unpack(data[: HEADER.size])
    if found != magic:
        raise ContainerError("not a container")
    return Header(tag.decode("ascii"), (major, minor), flags, offset, length, digest)


def scan(data: bytes, base: int = 0) -> Iterator[tuple[str, int, int]]:
    """Type, offset and stored size of each record; values are not decoded."""
    at = 0
    while at < len(data):
        if at + RECORD.size > len(data):
            raise ContainerError("a chunk record is cut off")
        kind, size = RECORD.unpack_from(data, at)
        at += RECORD.size
        if at + size > len(data):
            raise ContainerError("a chunk value is cut off")
        yield kind.decode("ascii"), base + at, size
        at += size


def opened(value: bytes) -> tuple[int, int, bytes]:
    """Codec, slot and content; sealed content stays as it is."""
    if len(value) < 2:
        raise ContainerError("a chunk value is cut off")
    codec, slot = value[0], value[1]
    if codec not in (STORED, ZSTD):
        raise ContainerError(f"codec {codec} is not known")
    return codec, slot, value[2:] if slot or codec == STORED else zstandard.ZstdDecompressor().decompress(value[2:])


def decode(data: bytes) -> list[Chunk]:
    out = []
    for kind, at, size in scan(data):
        _, slot, raw = opened(data[at : at + size])
        out.append(Chunk(kind, b"", decode(raw), slot) if kind in LISTS and not slot else Chunk(kind, raw, [], slot))
    return out


def unpack(data: bytes, verify: bool = True, magic: bytes = MAGIC) -> tuple[Header, list[Chunk]]:
    """Nothing is used before the hash of the whole body is checked."""
    head = header(data, magic)
    body = data[head.offset : head.offset + head.length]
    if len(body) < head.length:
        raise ContainerError("the body is cut off")
    if verify and hashlib.sha256(body).digest() != head.digest:
        raise ContainerError("the content does not match its hash")
    return head, decode(body)


def unpack_some(data: bytes, enough: Callable[[list[Chunk]], bool], magic: bytes = MAGIC) -> tuple[Header, list[Chunk], bool]:
    """A prefix of the payload's children, until ``enough`` says so, and whether it is all. The whole body is still hashed;
    a payload compressed as one or sealed is read whole. What comes back must not be written."""
    head = header(data, magic)
    body = data[head.offset : head.offset + head.length]
    if hashlib.sha256(body).digest() != head.digest:
        raise ContainerError("the content does not match its hash")
    out, whole = [], True
    for kind, at, size in scan(body):
        value = body[at : at + size]
        codec, slot, raw = opened(value)
        if kind == "DATA" and not slot and codec == STORED:
            children: list[Chunk] = []
            for inner, a, n in scan(raw):
                if enough(children):
                    whole = False
                    break
                _, s, content = opened(raw[a : a + n])
                children.append(Chunk(inner, b"", decode(content), s) if inner in LISTS and not s else Chunk(inner, content, [], s))
            out.append(Chunk(kind, b"", children))
        else:
            out.append(Chunk(kind, b"", decode(raw), slot) if kind in LISTS and not slot else Chunk(kind, raw, [], slot))
    return head, out, whole


def read_containers(spark: SparkSession, path: str, verify: bool = True, values: bool = True, magic: bytes = MAGIC) -> DataFrame:
    """One row per chunk of every file, nested ones included; without ``values`` only places and sizes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(name: str, data: bytes, base: int, parent: str) -> Iterator[tuple]:
        for pos, (kind, at, size) in enumerate(scan(data, base)):
            value = data[at - base : at - base + size]
            codec, slot, raw = opened(value)
            here = f"{parent}/{kind}[{pos}]".lstrip("/")
            yield name, here, parent, pos, kind, codec, slot, at, size, raw if values and kind not in LISTS else None
            if kind in LISTS and not slot:
                yield from rows(name, raw, at + 2 if codec == STORED else 0, here)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for name, content in frame.itertuples(index=False):
                head = header(content, magic)
                body = content[head.offset : head.offset + head.length]
                if verify and hashlib.sha256(body).digest() != head.digest:
                    raise ContainerError(f"{name}: the content does not match its hash")
                found += rows(name, body, head.offset, "")
            yield pd.DataFrame(found, columns=[f.split()[0] for f in SHAPE.split(", ")])

    return files.mapInPandas(of, SHAPE)


def info(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    """Headers alone: ``file``, ``tag``, ``version``, ``flags``, ``length``."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, HEADER.size).alias("head"))

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            heads = [(p, header(bytes(h), magic)) for p, h in frame.itertuples(index=False)]
            yield pd.DataFrame([(p, h.tag, f"{h.version[0]}.{h.version[1]}", h.flags, h.length) for p, h in heads], columns=["file", "tag", "version", "flags", "length"])

    return files.mapInPandas(of, "file string, tag string, version string, flags long, length long")


def tally(chunks: DataFrame) -> DataFrame:
    """Chunks and bytes by type, in order of first appearance."""
    from pyspark.sql import functions as F

    return chunks.groupBy("file", "type").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"), F.min("pos").alias("first")).orderBy("file", "first", "type")


def encode_value(value) -> bytes:
    """A nested value as tagged bytes: null, booleans, 64-bit integers, doubles, texts, bytes, lists and ordered maps."""
    sized = lambda b: struct.pack("<I", len(b)) + b
    match value:
        case None:
            return b"\0"
        case bool():
            return bytes([1, value])
        case int():
            return b"\2" + struct.pack("<q", value)
        case float():
            return b"\3" + struct.pack("<d", value)
        case str():
            return b"\4" + sized(value.encode())
        case bytes():
            return b"\5" + sized(value)
        case list():
            return b"\6" + struct.pack("<I", len(value)) + b"".join(map(encode_value, value))
        case dict():
            return b"\7" + struct.pack("<I", len(value)) + b"".join(sized(k.encode()) + encode_value(v) for k, v in value.items())
    raise ContainerError(f"a {type(value).__name__} cannot be stored")


def decode_value(data: bytes):
    """The value again; bytes left over are an error."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ContainerError("a value is cut off")
        at += n
        return data[at - n : at]

    def count() -> int:
        return struct.unpack("<I", take(4))[0]

    def one():
        tag = take(1)[0]
        readers = {0: lambda: None, 1: lambda: take(1) != b"\0", 2: lambda: struct.unpack("<q", take(8))[0], 3: lambda: struct.unpack("<d", take(8))[0], 4: lambda: take(count()).decode(), 5: lambda: take(count()), 6: lambda: [one() for _ in range(count())], 7: lambda: {take(count()).decode(): one() for _ in range(count())}}
        if tag not in readers:
            raise ContainerError(f"value tag {tag} is not known")
        return readers[tag]()

    out = one()
    if at < len(data):
        raise ContainerError(f"{len(data) - at} bytes are left over after the value")
    return out
