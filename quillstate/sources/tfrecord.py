"""TFRecord files of Example messages, without any jar.

A record is a little-endian length, its masked CRC-32C, the message, and the message's
masked CRC-32C. Messages hold a map of features: lists of bytes, floats (packed) or 64-bit
integers (varints). Only flat columns are read and written: integers, floats, strings.
Files are the unit of work: a file is streamed by one task, some megabytes at a time, through
the file systems that pyarrow knows. Messages are made column by column, checks are
computed for all records of a block side by side.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RECORDS_PER_FILE = 1_000_000


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _table()


_WIDE_CRC = np.array(_CRC, np.uint32)


def masked_crcs(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of each message, rotated by 15 bits and moved by a constant, as the format asks.

    All messages are taken a byte at a time side by side, longest first.
    """
    sizes = np.array([len(m) for m in messages], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(messages), np.uint8)
    starts = np.r_[0, np.cumsum(sizes)[:-1]][order] if len(sizes) else sizes
    crc, left = np.full(len(sizes), 0xFFFFFFFF, np.uint32), sizes[order]
    live = len(left)
    for i in range(int(left[0]) if live else 0):
        live = int(np.searchsorted(-left[:live], -i, side="left"))  # those longer than i
        c = crc[:live]
        crc[:live] = _WIDE_CRC[(c ^ data[starts[:live] + i]) & 0xFF] ^ c >> np.uint32(8)
    crc ^= np.uint32(0xFFFFFFFF)
    out = np.empty(len(sizes), np.uint32)
    out[order] = (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)
    return out


def masked_crc(data: bytes) -> int:
    return int(masked_crcs([data])[0])


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[i]
        n |= (c & 0x7F) << shift
        i += 1
        if c < 0x80:
            return n, i
        shift += 7


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _features(name: str, values: pa.Array) -> list[bytes]:
    """The map entry of one column in every row; nothing where the value is NULL."""
    key = _field(1, name.encode())
    if pa.types.is_floating(values.type):
        # a float takes the same number of bytes in every row
        data, width = values.cast(pa.float32()).fill_null(0).to_numpy(zero_copy_only=False).astype("<f4").tobytes(), 4
        head = _field(1, key + _field(2, _field(2, _field(1, b"0000"))))[:-4]
        made = [head + data[i : i + width] for i in range(0, len(data), width)]
    elif pa.types.is_integer(values.type):
        @lru_cache(1 << 16)
        def one(v: int) -> bytes:
            return _field(1, key + _field(2, _field(3, _field(1, _varint(v)))))

        made = [one(v) for v in values.fill_null(0).to_pylist()]
    else:
        kind = values.cast(pa.binary()) if not pa.types.is_boolean(values.type) else values.cast(pa.string()).cast(pa.binary())
        made = [_field(1, key + _field(2, _field(1, _field(1, v)))) for v in kind.fill_null(b"").to_pylist()]
    if values.null_count:
        made = [m if ok else b"" for m, ok in zip(made, values.is_valid().to_pylist())]
    return made


def encode_batch(batch: pa.RecordBatch) -> list[bytes]:
    """A message of the non-NULL values of every row, made column by column."""
    columns = [_features(n, batch.column(i)) for i, n in enumerate(batch.schema.names)]
    return [_field(1, b"".join(row)) for row in zip(*columns)] if columns else [_field(1, b"")] * batch.num_rows


def encode_example(row: dict) -> bytes:
    """A message of the non-NULL values of a row."""
    kept = {k: v for k, v in row.items() if v is not None}
    return encode_batch(pa.RecordBatch.from_pydict({k: [v] for k, v in kept.items()}))[0] if kept else _field(1, b"")


def _fields(b: bytes) -> Iterator[tuple[int, int, object]]:
    i = 0
    while i < len(b):
        tag, i = _read_varint(b, i)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, i = _read_varint(b, i)
        elif wire == 2:
            n, i = _read_varint(b, i)
            value, i = b[i : i + n], i + n
        elif wire == 5:
            value, i = b[i : i + 4], i + 4
        elif wire == 1:
            value, i = b[i : i + 8], i + 8
        else:
            raise ValueError(f"wire type {wire}")
        yield number, wire, value


def decode_example(b: bytes) -> dict:
    """First value of every feature."""
    return Decoder()(b)


class Decoder:
    """Messages to rows. Records of a file repeat their features, so what an entry of bytes says is kept."""

    def __init__(self):
        self.entry = lru_cache(1 << 16)(self._entry)

    def __call__(self, b: bytes) -> dict:
        out: dict = {}
        for _, _, features in _fields(b):
            i, end = 0, len(features)
            while i < end:
                # entries are short: one byte of tag, one or two of length
                if features[i] == 10 and i + 1 < end and features[i + 1] < 0x80:
                    n, i = features[i + 1], i + 2
                else:
                    _, i = _read_varint(features, i)
                    n, i = _read_varint(features, i)
                found = self.entry(features[i : i + n])
                if found:
                    out[found[0]] = found[1]
                i += n
        return out

    @staticmethod
    def _entry(entry: bytes) -> tuple[str, object] | None:
        parts = {n: v for n, _, v in _fields(entry)}
        for kind, _, data in _fields(parts.get(2, b"")):
            first = next(iter(_fields(data)), None)
            if first is None:
                continue
            _, wire, v = first
            if kind == 2:
                v = struct.unpack("<f", v[:4])[0]
            elif kind == 3:
                v = _read_varint(v, 0)[0] if wire == 2 else v
                v = v - (1 << 64) if v >= 1 << 63 else v
            return parts[1].decode(), v
        return None


def frames(messages: list[bytes]) -> bytes:
    """Messages with their lengths and checks, one after another."""
    heads = [struct.pack("<Q", len(m)) for m in messages]
    parts = zip(heads, masked_crcs(heads).astype("<u4").tolist(), messages, masked_crcs(messages).astype("<u4").tolist())
    return b"".join([x for h, hc, m, mc in parts for x in (h, struct.pack("<I", hc), m, struct.pack("<I", mc))])


def frame(message: bytes) -> bytes:
    return frames([message])


def unframe(stream, verify: bool = True, block: int = 8 << 20) -> Iterator[list[bytes]]:
    """Lists of messages: the whole records of one block of the file after another, checked together."""
    rest = b""
    while True:
        more = stream.read(block)
        data, at, heads, messages, checks = rest + more, 0, [], [], []
        while at + 12 <= len(data):
            n, crc = struct.unpack_from("<QI", data, at)
            if verify and n > len(data) and masked_crc(data[at : at + 8]) != crc:
                raise ValueError("record length is damaged")
            if at + 16 + n > len(data):
                break
            heads.append((data[at : at + 8], crc))
            messages.append(data[at + 12 : at + 12 + n])
            checks.append(struct.unpack_from("<I", data, at + 12 + n)[0])
            at += 16 + n
        if verify and messages:
            if (masked_crcs([h for h, _ in heads]) != np.array([c for _, c in heads], np.uint32)).any():
                raise ValueError("record length is damaged")
            if (masked_crcs(messages) != np.array(checks, np.uint32)).any():
                raise ValueError("record is damaged")
        if messages:
            yield messages
        rest = data[at:]
        if not more:
            break
    if rest:
        raise ValueError("record is damaged")


def _open(path: str):
    """File system and path of a URI or a plain path, as Python tasks see them."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write(df: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> int:
    """Record files of at most ``records_per_file`` records; returns their number.

    Tasks write below ``_temporary``; when all are done the files of successful attempts are
    moved into place, so a retried task leaves nothing behind.
    """
    temporary = f"{path.rstrip('/')}/_temporary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(temporary)
        system.create_dir(root, recursive=True)
        tag, files, out, n = uuid.uuid4().hex, [], None, 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                if out is None or n == records_per_file:
                    if out is not None:
                        out.close()
                    files.append(f"part-{tag}-{len(files):05d}.tfrecord")
                    out, n = system.open_output_stream(f"{root}/{files[-1]}"), 0
                part = b.slice(at, min(b.num_rows - at, records_per_file - n))
                out.write(frames(encode_batch(part)))
                at, n = at + part.num_rows, n + part.num_rows
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], ["file"])

    written = [r.file for r in df.mapInArrow(run, "file string").collect()]  # one name per file
    system, root = _open(path)
    system.create_dir(root, recursive=True)
    for f in written:
        system.move(f"{root}/_temporary/{f}", f"{root}/{f}")
    if written:
        system.delete_dir(f"{root}/_temporary")
    with system.open_output_stream(f"{root}/_SUCCESS"):
        pass
    return len(written)


def read(spark: SparkSession, path: str, schema: T.StructType, verify: bool = True) -> DataFrame:
    """Rows of record files; a feature that a record lacks is NULL. One task streams a file block by block."""
    kinds = [(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.float32() if isinstance(f.dataType, T.FloatType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64()) for f in schema]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        cols = [pa.array([v.decode() if isinstance(v := r.get(n), bytes) else v for r in rows], k) for n, k in kinds]
        return pa.RecordBatch.from_arrays(cols, [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder()
        for b in batches:
            for name in b.column(0).to_pylist():
                system, at = _open(name)
                with system.open_input_stream(at) as stream:
                    for messages in unframe(stream, verify):
                        for i in range(0, len(messages), 10_000):
                            yield batch([decode(m) for m in messages[i : i + 10_000]])

    # only the paths are read here; contents are streamed by the tasks
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tfrecord*").load(path).select("path")
    return files.mapInArrow(run, schema)
