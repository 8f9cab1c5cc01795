"""Sequence files of any size as a Spark data source: byte ranges are read apart, contigs are put together after."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from palindra.functions.running import before

SCHEMA = "file string, start long, no long, record long, seqid string, piece string"
#: Bytes of a partition, bases of a row, bytes read at a time.
PARTITION, PIECE, CHUNK = 64 << 20, 1 << 20, 1 << 20
_NAMES = ["file", "start", "no", "record", "seqid", "piece"]


@dataclass
class Span(InputPartition):
    """The bytes from ``start`` to below ``stop`` of a file; a packed one is read whole."""

    path: str
    start: int
    stop: int
    packed: bool
    fastq: bool


@dataclass
class _Found:
    path: str
    size: int
    #: When it was last written, and its path: the order in which a stream takes files.
    mark: tuple[int, str]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _listed(paths: list[str]) -> list[_Found]:
    """Files, and those of folders that are not hidden, in the order of their paths."""
    out = []
    for path in paths:
        store, at = _store(path)
        info = store.get_file_info(at)
        inside = store.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
        for x in sorted(inside, key=lambda x: x.path):
            if x.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            if x.type == fs.FileType.File and (inside[0] is info or not x.base_name.startswith(("_", "."))):
                whole = path if inside[0] is info else f"{path.rstrip('/')}/{x.base_name}"
                out.append(_Found(whole, x.size, (x.mtime_ns or 0, whole)))
    return out


def _opened(path: str, packed: bool) -> BinaryIO:
    store, at = _store(path)
    file = store.open_input_file(at)
    return gzip.GzipFile(fileobj=file) if packed else file


def _spans(files: list[_Found], size: int) -> list[Span]:
    """The partitions of files. What a file is, its first bytes say: the name has no part in it."""
    out = []
    for x in files:
        with _opened(x.path, False) as file:
            packed = file.read(2) == b"\x1f\x8b"
        with _opened(x.path, packed) as file:
            head = b""
            while not head.strip() and (more := file.read(4096)):
                head = more
        fastq = head.lstrip().startswith(b"@")
        out += [Span(x.path, s, min(s + size, x.size), packed, fastq) for s in range(0, x.size, x.size if packed else size)]
    return out


def _lines(span: Span) -> Iterator[bytes | None]:
    """Lines that begin in ``span``, without their ends; then None and those after it, for a record that goes on."""
    with _opened(span.path, span.packed) as file:
        at, rest = span.start, b""
        if at and not span.packed:
            file.seek(at - 1)  # the first whole line begins after the first line feed from here on
            at -= 1
        skip, marked = at < span.start, span.packed
        while True:
            chunk = file.read(CHUNK)
            lines = (rest + chunk).split(b"\n")
            rest = lines.pop() if chunk else b""
            for line in lines:
                if skip:
                    skip = False
                else:
                    if not marked and at >= span.stop:
                        marked = True
                        yield None
                    yield line
                at += len(line) + 1
            if not chunk:
                return


def _fasta(lines: Iterator[bytes | None]) -> Iterator[tuple[int, str | None, str]]:
    """(records begun so far in the span, id where one begins, bases): of a contig in pieces."""
    record, seqid, held, size = 0, None, [], 0
    for line in lines:
        if line is None:
            break
        if line[:1] == b">":
            if held or seqid is not None:
                yield record, seqid, b"".join(held).decode(errors="replace").upper()
            name = line[1:].split(b"\r")[0]
            record, seqid, held, size = record + 1, (re.match(rb"[^ \t\n\x0b\f\r]*", name)[0]).decode(errors="replace"), [], 0
            continue
        held.append(b"".join(line.split()))
        size += len(held[-1])
        if size >= PIECE:
            yield record, seqid, b"".join(held).decode(errors="replace").upper()
            seqid, held, size = None, [], 0
    if held or seqid is not None:
        yield record, seqid, b"".join(held).decode(errors="replace").upper()


def _fastq(lines: Iterator[bytes | None], whole: bool) -> Iterator[tuple[int, str | None, str]]:
    """Records of four lines that begin in the span. A span's first is where a line of ``@`` has one of ``+`` two lines on:
    after a quality line that begins with ``@`` stand a header and bases."""
    record, held, synced, over = 0, [], whole, False
    for line in lines:
        if line is None:
            over = True
            continue
        line = line.rstrip(b"\r")
        if not line and not held:
            continue
        held.append((line, not over))
        if not held[0][1]:
            return
        if not synced and len(held) == 3:
            synced = held[0][0].startswith(b"@") and held[2][0].startswith(b"+")
            if not synced:
                held.pop(0)
        if synced and len(held) == 4:
            record += 1
            yield record, re.match(rb"@?([^ \t\n\x0b\f\r]*)", held[0][0])[1].decode(errors="replace"), b"".join(held[1][0].split()).decode(errors="replace").upper()
            held = []


def _pieces(span: Span) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    found = _fastq(_lines(span), span.start == 0) if span.fastq else _fasta(_lines(span))
    for no, (record, seqid, piece) in enumerate(found):
        rows.append((span.path, span.start, no, record, seqid, piece))
        size += len(piece) + 64
        if size >= PIECE:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 3, pa.string(), pa.string()]
    return pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


class _Options:
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split("\n") if p]
        self.size = int(options.get("partitionbytes") or options.get("partitionBytes") or PARTITION)
        if not self.paths or self.size < 1:
            raise ValueError("a path, and partitions of a byte or more")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.of = _Options(options)

    def partitions(self) -> list[Span]:
        return _spans(_listed(self.of.paths), self.of.size)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _pieces(partition)


class _StreamReader(DataSourceStreamReader):
    """New files of folders. An offset is the last file taken, by when it was written and its path."""

    def __init__(self, options: dict[str, str]):
        self.of = _Options(options)

    def initialOffset(self) -> dict:
        return {"written": -1, "path": ""}

    def latestOffset(self) -> dict:
        written, path = max((x.mark for x in _listed(self.of.paths)), default=(-1, ""))
        return {"written": written, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        low, high = ((x["written"], x["path"]) for x in (start, end))
        return _spans([x for x in _listed(self.of.paths) if low < x.mark <= high], self.of.size)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _pieces(partition)

    def commit(self, end: dict) -> None:
        pass


class SequenceSource(DataSource):
    """``spark.read.format("sequences").option("paths", ...)``: pieces of the contigs of FASTA and FASTQ files.

    ``paths`` has one path or folder a line; ``partitionBytes`` is how long a partition's range is. Stores are those
    that Arrow knows by their address. A gzipped file, told by its first bytes, is one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def whole_contigs(pieces: DataFrame) -> DataFrame:
    """(file, contig_no, seqid, seq) of the pieces that the source reads.

    A span only knows how many records began in it, so the counts of the spans before, a row each,
    say which contig a piece belongs to; what precedes a file's first record goes. A contig's pieces meet in one row.
    """
    spans = pieces.groupBy("file", "start").agg(F.max("record").alias("begun"))
    spans = before(spans, "begun", "earlier", ["file"], ["start"], F.floor(F.col("start") / (1 << 40)), "sum").select("file", "start", "earlier")
    rows = pieces.join(spans, ["file", "start"]).withColumn("contig_no", (F.col("earlier") + F.col("record") - 1).cast("long")).where("contig_no >= 0")
    parts = F.sort_array(F.collect_list(F.struct("start", "no", "piece")))
    return rows.groupBy("file", "contig_no").agg(F.max("seqid").alias("seqid"), parts.alias("parts")).select("file", "contig_no", "seqid", F.array_join("parts.piece", "").alias("seq"))


def read_split(spark: SparkSession, paths: str | list[str], partition_bytes: int = PARTITION) -> DataFrame:
    """Contigs of FASTA and FASTQ files or folders of them, gzipped or not, read in byte ranges.

    The rows of ``fasta.read_sequences``, but a file may have any size, a contig 2 GB.
    """
    spark.dataSource.register(SequenceSource)
    listed = "\n".join([paths] if isinstance(paths, str) else paths)
    return whole_contigs(spark.read.format("sequences").option("paths", listed).option("partitionBytes", str(partition_bytes)).load())
