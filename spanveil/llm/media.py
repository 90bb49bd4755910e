"""Media columns: payloads as lossless 8-bit grey images in archives, read by a custom Spark data source.

write_archives() streams texts into zip archives of stored PNG members, an archive a task, under one folder.
The data source ``media_archive`` plans byte ranges over that folder's archives from their sizes alone; a task
reads its archive's directory, takes the members that begin in its range, and streams them through Arrow.  A
member that can't be read is tried again by itself, at its own offset, and after that comes out with its error.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Payloads are padded with bytes 255, which UTF-8 never has, to a positive multiple of a row of samples.
WIDTH = 576
_SIGN = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw)) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey image of rows of WIDTH samples, no filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return _SIGN + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of to_png()'s image; ValueError for anything else and for damage."""
    if media[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, data, height = 8, [], 0
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not an 8-bit grey image of that width")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """rows:mean:bits - the mean sample and, in hex, which of 64 equal stretches of the samples are above it."""
    x = np.frombuffer(payload, np.uint8)
    parts = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64)
    sizes = np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    above = parts * len(x) > sizes * int(x.sum(dtype=np.int64))
    return f"{len(x) // WIDTH}:{x.mean():.3f}:{np.packbits(above).tobytes().hex()}"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes an archive a task into ``folder`` (a URI that all nodes reach). Keys may be null or repeat: each row is a member.

    An archive gets its final name only when it is whole; a task that runs again replaces it by the same.  A task
    without rows writes none, so an empty table leaves an empty folder, which read_archives() reads as no rows.
    """
    _fs(folder)[0].create_dir(_fs(folder)[1], recursive=True)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        system, root = _fs(folder)
        name = f"part-{TaskContext.get().partitionId():06d}"
        tmp, n = f"{root}/.{name}-{uuid.uuid4().hex}", 0
        batches = (b for b in batches if len(b))
        if (first := next(batches, None)) is None:
            return
        batches = itertools.chain([first], batches)
        try:
            with system.open_output_stream(tmp) as out, zipfile.ZipFile(_Counted(out), "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                for batch in batches:
                    for k, t in zip(batch.column(key), batch.column(text), strict=True):
                        k = k.as_py()
                        info = zipfile.ZipInfo(f"{n}.png" if k is None else f"{n}/{k}.png")
                        z.writestr(info, to_png(payload_of(t.as_py())))
                        n += 1
            system.move(tmp, f"{root}/{name}.zip")
        except BaseException:
            if system.get_file_info(tmp).type.name == "File":
                system.delete_file(tmp)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df.select(key, text).mapInArrow(run, "n long").agg({"n": "sum"}).collect()


class _Counted:
    """A write-only stream for zipfile that can't seek."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MediaArchive(DataSource):
    """Options: path (URI of a folder of zip archives), rangebytes (8388608), attempts (3), batchbytes (4194304), onerror (row: what can't be read is a row with its error; fail: it ends the job)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "key string, archive string, offset long, media binary, error string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range = int(options.get("rangebytes", 8 << 20))
        self.attempts = int(options.get("attempts", 3))
        self.batch = int(options.get("batchbytes", 4 << 20))
        self.fail = options.get("onerror", "row").lower()
        if self.fail not in ("row", "fail"):
            raise ValueError(f"onerror is row or fail, not {self.fail}")
        self.fail = self.fail == "fail"

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, root = _fs(self.folder)
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".zip"))
        return [Range(p, a, min(n, a + self.range)) for p, n in found for a in range(0, max(n, 1), self.range)]

    def again(self, what, name: str) -> tuple:
        """(what(), None), tried ``attempts`` times, or (None, the last error); with onerror=fail that is raised, with the name of what was read."""
        error = None
        for attempt in range(self.attempts):
            try:
                return what(), None
            except (OSError, ValueError, struct.error, zipfile.BadZipFile) as e:
                error = f"{type(e).__name__}: {e}"[:200]
                time.sleep(0.05 * 2**attempt if attempt + 1 < self.attempts else 0)
        if self.fail:
            raise OSError(f"{name}: {error}")
        return None, error

    def directory(self, system, path: str) -> list:
        with system.open_input_file(path) as f:
            if f.size() < 22:  # an end record; seeking before the start is another kind of error
                raise zipfile.BadZipFile("File is not a zip file")
            return zipfile.ZipFile(f).infolist()

    def member(self, system, path: str, info) -> bytes:
        """The member at its own offset, from a file opened anew, checked by its own CRC."""
        with system.open_input_file(path) as f:
            f.seek(info.header_offset)
            head = f.read(30)
            name, extra = struct.unpack_from("<HH", head, 26)
            f.seek(info.header_offset + 30 + name + extra)
            data = f.read(info.compress_size)
        if head[:4] != b"PK\3\4" or zlib.crc32(data) != info.CRC:
            raise OSError("damaged member")
        return data

    def read(self, part: Range | None) -> Iterator:
        import pyarrow as pa

        if part is None:  # a folder without archives
            return
        system, _ = _fs(self.folder)
        infos, error = self.again(lambda: self.directory(system, part.path), part.path)
        rows, size = [], 0
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        names = ["key", "archive", "offset", "media", "error"]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        # an archive that is none is reported once, by its first range; a read that failed by each range that it cost its members
        if error is not None and (part.start == 0 or not error.startswith("BadZipFile")):
            rows.append((None, os.path.basename(part.path), None, None, error))
        for info in (i for i in infos or [] if part.start <= i.header_offset < part.end):
            data, error = self.again(lambda info=info: self.member(system, part.path, info), f"{part.path}, {info.filename}")
            key = info.filename[:-4].partition("/")[2] if "/" in info.filename else None
            rows.append((key, os.path.basename(part.path), info.header_offset, data, error))
            size += len(data or b"")
            if size >= self.batch:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """key string, archive string, offset long, media binary (null if unreadable), error string (null if read).

    A folder without archives gives no rows; an archive whose directory can't be read gives a row with its error (one
    a range where the file can't be read).  With onerror="fail" nothing unreadable becomes a row: the job ends with the error.
    """
    spark.dataSource.register(MediaArchive)
    reader = spark.read.format("media_archive")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(folder)


def describe(members: DataFrame, media: str = "media", *, fail: bool = False) -> DataFrame:
    """``members`` with, in place of the media: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and error.

    All come from the stored bytes; a null medium or one that isn't such an image has nulls, and says in error why (what
    ``members`` has there stays).  With ``fail`` such a medium ends the job.
    """
    from .common import out_schema, put

    new = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "error": "string"}

    def one(m: bytes | None, error: str | None) -> tuple:
        try:
            p = from_png(m) if m is not None else None
            error = error or (None if m is not None else "no medium")
        except (ValueError, zlib.error, struct.error) as e:
            p, error = None, error or f"{type(e).__name__}: {e}"[:200]
        if fail and error:
            raise ValueError(error)
        if p is None:
            return (None,) * 4 + ((None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())) + (None, error)
        return len(p.rstrip(b"\xff")), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p), error

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            errors = batch.column("error").to_pylist() if "error" in batch.schema.names else [None] * len(batch)
            rows = [one(v.as_py(), e) for v, e in zip(batch.column(media), errors, strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(new)
            rest = batch.select([n for n in batch.schema.names if n != media])
            yield put(rest, {k: pa.array(c, pa.int64() if t == "long" else pa.string()) for (k, t), c in zip(new.items(), cols, strict=True)})

    return members.mapInArrow(run, out_schema(members.drop(media), new))
