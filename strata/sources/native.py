"""Reader and writer of the native log and run files, as a Python data source.

    spark.dataSource.register(NativeFiles)
    spark.read.format("strata_native").option("kind", "log").load(folder)

Frames are those of functions.codec. A log's torn tail ends it cleanly; a wrong checksum
raises. Run files hold records sorted by key, a Bloom filter, a sparse index and a footer;
those of the older format, without a filter, are read, too. Records come and go in Arrow
batches. Large run files are read in pieces, cut at index entries. A log file has no places
at which it could be cut and is one task's work; the writer begins another file every PIECE
bytes. With the option key, in hexadecimal, only the places that may hold that key are read:
files whose filter knows it, from the last index entry that is not above it to the next.
Folders are those of pyarrow's file systems: local, HDFS or object stores.

    df.sortWithinPartitions("key").write.format("strata_native").option("kind", "run").save(folder)
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.bloom import Bloom, size_for

# Fixed values of the format.
FOOTER = struct.Struct(">QIIIQI8s")
MAGIC = b"BTSSTB2X"
OLD_FOOTER = struct.Struct(">QIII8s")
OLD_MAGIC = b"BTSSTB1"
FLAG = 1 << 31
HEAD = struct.Struct(">IIqB")
#: Bytes that one task reads, about, and at which the writer begins another file.
PIECE = 64 << 20
#: Files that one task looks a key up in.
LOOKUPS = 64
#: Records of an Arrow batch.
BATCH = 10_000
SCHEMA = "key binary, value binary, ts bigint, is_deleted boolean, file string, pos bigint"
ARROW = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("ts", pa.int64()), ("is_deleted", pa.bool_()), ("file", pa.string()), ("pos", pa.int64())])
LOG_NAME = re.compile(r"wal-(\d+)\.log|wal\.log")
RUN_NAME = re.compile(r"(?:l(\d+)-)?sst-(\d+)\.sst")


class Corrupt(ValueError):
    """Bytes that are not what the format says."""


def frame(key: bytes, value: bytes | None, ts: int, is_deleted: bool) -> bytes:
    """A record as a frame with checksum."""
    body = b"" if is_deleted else value or b""
    payload = HEAD.pack(len(key), len(body), ts, is_deleted) + key + body
    return struct.pack(">I", len(payload) | FLAG) + payload + struct.pack(">I", zlib.crc32(payload))


def frames(data, end: int, torn_is_end: bool, start: int = 0) -> Iterator[tuple]:
    """(key, value, ts, is_deleted, position) of the frames of data[start:end].

    A frame that is cut short, or a length of zero, ends a log; in a run it raises.
    """
    at = start
    while at < end:
        start = at
        if at + 4 <= end:
            (marked,) = struct.unpack_from(">I", data, at)
            size = marked & ~FLAG
            stop = at + 4 + size + (4 if marked & FLAG else 0)
        if at + 4 > end or not size or stop > end:
            if torn_is_end:
                return
            raise Corrupt(f"record cut short at byte {start}")
        payload = data[at + 4 : at + 4 + size]
        if marked & FLAG and struct.unpack_from(">I", data, at + 4 + size)[0] != zlib.crc32(payload):
            raise Corrupt(f"record crc mismatch at byte {start}")
        if size < HEAD.size:
            raise Corrupt(f"invalid record encoding at byte {start}")
        key_size, value_size, ts, flag = HEAD.unpack_from(payload)
        if size != HEAD.size + key_size + value_size:
            raise Corrupt(f"invalid record encoding at byte {start}")
        key = bytes(payload[HEAD.size : HEAD.size + key_size])
        value = bytes(payload[HEAD.size + key_size :])
        deleted = flag == 1
        yield key, None if deleted else value, ts, deleted, start
        at = stop


@dataclass
class Run:
    """What the end of a run file says: where its records end, its index and its filter."""

    end: int
    keys: list[bytes]
    offsets: list[int]
    bloom: Bloom | None

    @classmethod
    def of(cls, f) -> Run:
        """Read the footer, index and filter of an open file, not its records."""
        size = f.size()
        if size < OLD_FOOTER.size:
            raise Corrupt("file without a footer")
        tail = f.read_at(min(size, FOOTER.size), max(0, size - FOOTER.size))
        footer = FOOTER.size
        if tail[-8:] == MAGIC and size >= footer:
            index_at, n_index, _, _, bloom_at, bloom_size, _ = FOOTER.unpack(tail)
        elif tail[-8:].rstrip(b"\0") == OLD_MAGIC:  # without a filter
            footer, bloom_at, bloom_size = OLD_FOOTER.size, 0, 0
            index_at, n_index, _, _, _ = OLD_FOOTER.unpack(tail[-footer:])
        else:
            raise Corrupt("wrong footer")
        end = bloom_at if bloom_size else index_at
        if not end <= index_at <= size - footer or bloom_at + bloom_size > index_at:
            raise Corrupt("wrong footer")
        block = f.read_at(size - footer - index_at, index_at)
        keys, offsets, at = [], [], 0
        for _ in range(n_index):
            (n,) = struct.unpack_from(">I", block, at) if at + 12 <= len(block) else (len(block),)
            if at + 12 + n > len(block):
                raise Corrupt("index cut short")
            keys.append(block[at + 4 : at + 4 + n])
            offsets.append(struct.unpack_from(">Q", block, at + 4 + n)[0])
            at += 12 + n
        bloom = Bloom.unpack(f.read_at(bloom_size, bloom_at)) if bloom_size else None
        return cls(end, keys, offsets, bloom)

    def piece(self, k: int, most: int = PIECE) -> tuple[int, int] | None:
        """The k-th range of records: those whose index entries lie in the k-th stretch of `most` bytes. None if there are none."""
        if not self.offsets:
            return (0, self.end) if k == 0 and self.end else None
        first, after = (bisect.bisect_left(self.offsets, x * most) for x in (k, k + 1))
        if first == after:
            return None
        return self.offsets[first], self.offsets[after] if after < len(self.offsets) else self.end

    def seek(self, key: bytes) -> tuple[int, int] | None:
        """The range of records in which a key can be, None if it cannot be there (LK4, LK5)."""
        if self.bloom is not None and not self.bloom.might_contain(key):
            return None
        if not self.offsets:
            return (0, self.end)
        i = bisect.bisect_right(self.keys, key) - 1
        if i < 0:
            return None
        return self.offsets[i], self.offsets[i + 1] if i + 1 < len(self.offsets) else self.end


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; a name without a scheme is a local one."""
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{os.path.abspath(uri)}")


def _files(at: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return [i for i in at.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File]


def log_files(names: Iterable[str]) -> list[str]:
    """Names of log files in order: archives by number, then the active one (SC4). Other names are left out."""
    found = [(m, n) for n in names if (m := LOG_NAME.fullmatch(n))]
    return [n for _, n in sorted(((m[1] is None, int(m[1] or 0)), n) for m, n in found)]


def run_files(names: Iterable[str]) -> list[str]:
    """Names of run files by level and sequence; names without a level are of level 0 (SC11)."""
    found = [(int(m[1] or 0), int(m[2]), n) for n in names if (m := RUN_NAME.fullmatch(n))]
    return [n for _, _, n in sorted(found)]


def level_and_seq(path: Column, kind: str = "sst", suffix: str = "sst") -> tuple[Column, Column]:
    """Level and sequence out of paths of run files (SC11); null for other names, level 0 where the name has none."""
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    pattern = rf"^(?:l(\d+)-)?{kind}-(\d+)\.{suffix}$"
    seq = F.regexp_extract(name, pattern, 2)
    level = F.regexp_extract(name, pattern, 1)
    known = seq != ""
    return F.when(known, F.when(level != "", level).otherwise("0").cast("bigint")), F.when(known, seq.cast("bigint"))


class _Pieces(InputPartition):
    """(file name, which piece of it) of one task."""

    def __init__(self, pieces: list[tuple[str, int]]) -> None:
        super().__init__(None)
        self.pieces = pieces


class _Reader(DataSourceReader):
    """The driver only lists the folder; footers, indexes and filters are read by the tasks."""

    def __init__(self, folder: str, kind: str, key: bytes | None) -> None:
        self.folder, self.kind, self.key = folder, kind, key

    def partitions(self) -> list[InputPartition]:
        at, folder = _opened(self.folder)
        sizes = {i.base_name: i.size for i in _files(at, folder)}
        pieces = []
        for name in (log_files if self.kind == "log" else run_files)(sizes):
            whole = self.kind == "log" or self.key is not None
            pieces += [(name, k, sizes[name]) for k in range(1 if whole else -(-sizes[name] // PIECE))]
        tasks: list[_Pieces] = []
        held = PIECE
        for name, k, size in pieces:  # small files share a task; in a lookup only a file's end and some records are read
            size = min(PIECE, size) if self.key is None else PIECE // LOOKUPS
            if held + size > PIECE:
                tasks.append(_Pieces([]))
                held = 0
            tasks[-1].pieces.append((name, k))
            held += size
        return tasks

    def _records(self, pieces: list[tuple[str, int]]) -> Iterator[tuple]:
        at, folder = _opened(self.folder)
        for name, k in pieces:
            with at.open_input_file(f"{folder}/{name}") as f:
                if self.kind == "log":
                    span = (0, f.size())
                else:
                    run = Run.of(f)
                    span = run.piece(k) if self.key is None else run.seek(self.key)
                if span is None:
                    continue
                start, data = span[0], memoryview(f.read_at(span[1] - span[0], span[0]))
                for key, value, ts, deleted, pos in frames(data, len(data), self.kind == "log"):
                    if self.key is None or key == self.key:
                        yield key, value, ts, deleted, name, start + pos
                    elif self.kind == "run" and key > self.key:
                        break

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        records = self._records(partition.pieces if isinstance(partition, _Pieces) else [])
        while rows := list(itertools.islice(records, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class _Done(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Writer(DataSourceArrowWriter):
    """Files of each task that has rows, of about PIECE bytes each, named when all have ended; a failed task leaves none."""

    def __init__(self, folder: str, names: list[str], kind: str, level: int, gap: int) -> None:
        self.folder, self.kind, self.level, self.gap = folder, kind, level, gap if gap > 0 else 10
        self.at = [names.index(n) for n in ("key", "value", "ts", "is_deleted")]

    def _records(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        for batch in batches:
            for key, value, ts, deleted in zip(*[batch.column(i).to_pylist() for i in self.at]):
                yield key, frame(key, value, ts, bool(deleted))

    def _write_log(self, f, records: Iterator[tuple[bytes, bytes]]) -> bool:
        """Records until the file is full; whether any are left."""
        at = 0
        for _, data in records:
            f.write(data)
            at += len(data)
            if at >= PIECE:
                return True
        return False

    def _write_run(self, f, records: Iterator[tuple[bytes, bytes]]) -> bool:
        """Records until the file is full, filter, index and footer; keys must ascend. Whether any are left."""
        keys: list[bytes] = []
        index: list[bytes] = []
        at, left = 0, False
        for key, data in records:
            if key <= self.last if self.last is not None else False:
                raise ValueError("rows of a run must be sorted by key, one for each key: use sortWithinPartitions")
            self.last = key
            if len(keys) % self.gap == 0:
                index.append(struct.pack(">I", len(key)) + key + struct.pack(">Q", at))
            keys.append(key)
            f.write(data)
            at += len(data)
            if left := at >= PIECE:
                break
        if keys:
            bloom = Bloom(*size_for(len(keys)))
            bloom.add(*keys)
            block = bloom.pack()
            f.write(block + b"".join(index) + FOOTER.pack(at + len(block), len(index), len(keys), self.gap, at, len(block), MAGIC))
        return left

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        at, folder = _opened(self.folder)
        at.create_dir(folder, recursive=True)
        records, names, left = self._records(iterator), [], True
        self.last: bytes | None = None
        try:
            while left:
                names.append(f".task-{context.partitionId():06d}-{context.taskAttemptId()}-{len(names):06d}.tmp")
                with at.open_output_stream(f"{folder}/{names[-1]}") as f:
                    left = self._write_run(f, records) if self.kind == "run" else self._write_log(f, records)
        except BaseException:
            for name in names:
                at.delete_file(f"{folder}/{name}")
            raise
        return _Done(names)

    def commit(self, messages: list) -> None:
        at, folder = _opened(self.folder)
        sizes = {i.base_name: i.size for i in _files(at, folder)}
        pattern, number = (RUN_NAME, 2) if self.kind == "run" else (LOG_NAME, 1)
        next_number = max((int(m[number]) for n in sizes if (m := pattern.fullmatch(n)) and m[number]), default=0) + 1
        for name in sorted(n for m in messages if m for n in m.names):
            if not sizes[name]:  # a task without rows, or without rows after a full file
                at.delete_file(f"{folder}/{name}")
                continue
            new = f"l{self.level}-sst-{next_number:020d}.sst" if self.kind == "run" else f"wal-{next_number:06d}.log"
            at.move(f"{folder}/{name}", f"{folder}/{new}")
            next_number += 1

    def abort(self, messages: list) -> None:
        at, folder = _opened(self.folder)
        for name in (n for m in messages if m for n in m.names):
            try:
                at.delete_file(f"{folder}/{name}")
            except FileNotFoundError:
                pass


class NativeFiles(DataSource):
    """Folders of native log (kind=log, the default) or run files (kind=run); the folder must be shared."""

    @classmethod
    def name(cls) -> str:
        return "strata_native"

    def schema(self) -> str:
        return SCHEMA

    def _kind(self) -> str:
        kind = self.options.get("kind", "log")
        if kind not in ("log", "run"):
            raise ValueError(f"kind is log or run, not {kind}")
        return kind

    def reader(self, schema) -> DataSourceReader:
        key = self.options.get("key")
        return _Reader(self.options["path"], self._kind(), bytes.fromhex(key) if key is not None else None)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        level, gap = (int(self.options.get(n, d)) for n, d in (("level", 0), ("gap", 10)))
        return _Writer(self.options["path"], schema.names, self._kind(), level, gap)
