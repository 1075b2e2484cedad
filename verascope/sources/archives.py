"""Web-archive text files (a gzip member for each record) as a data source with record-aligned splits, and their writer.

A file is cut into byte ranges; a task reads the members that start in its range, wherever the last one ends. A range finds its
first member by the gzip header, checked by what it unpacks to. With a limit of accepted records a file is one task that stops
reading once it has them. Members are unpacked piece by piece, so a task holds a record, not a file.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from verascope.functions.scalars import ENGLISH_WORDS

NAME = "web_archive"
MARK = b"WARC/1.0\r\n"
#: The first bytes of a gzip member; the flags and the rest of its header vary.
_GZIP = b"\x1f\x8b\x08"
_PIECE = 1 << 16
#: Unicode's white space, which the expressions trim.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_WORDS = re.compile(f"[^{_WHITE}]+")
_HOST = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[w.]*([^/?#]*)")


def accepted(block: str, min_chars: int = 80) -> bool:
    """Whether bronze.parse_archive_blocks() keeps a block: a conversion with a host and enough English text."""
    head, _, body = block.partition("\r\n\r\n")
    field = lambda k: m.group(1) if (m := re.search(rf"(?im)^{k}: *([^\r\n]*)", head)) else ""
    if field("WARC-Type") != "conversion":
        return False
    body = body.strip(_WHITE)
    host = _HOST.match(field("WARC-Target-URI").lower())
    words = set(_WORDS.findall(body[:600].lower()))
    return len(body) >= min_chars and bool(host and host.group(1)) and len(words.intersection(ENGLISH_WORDS)) >= 4


class _File:
    """Sequential reads from a place on, with a count of how far they went."""

    def __init__(self, path: str, at: int):
        system, name = fs.FileSystem.from_uri(path)
        self.stream = system.open_input_file(name)
        self.at = at

    def read(self) -> bytes:
        self.stream.seek(self.at)
        piece = self.stream.read(_PIECE)
        self.at += len(piece)
        return piece


def _is_member(data: bytes) -> bool:
    """Whether data begins with a member that unpacks to a record's mark."""
    try:
        return zlib.decompressobj(31).decompress(data, len(MARK)) == MARK
    except zlib.error:
        return False


def first_member(file: _File, end: int) -> tuple[int, bytes] | None:
    """(place, data read from there on) of the first member at or after the file's place and before end."""
    base, data = file.at, b""
    while True:
        at = data.find(_GZIP)
        if at < 0:
            keep = data[-2:]
            base += len(data) - len(keep)
            piece = file.read()
            if not piece or base >= end:
                return None
            data = keep + piece
            continue
        if base + at >= end:
            return None
        while len(data) - at < 4096 and (piece := file.read()):  # a header, and enough of the first block to tell
            data += piece
        if _is_member(data[at:]):
            return base + at, data[at:]
        base, data = base + at + 1, data[at + 1 :]


def records(file: _File, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """(place of the member, number in it, block) of the records in members that start from start on and before end."""
    file.at = start
    found = first_member(file, end)
    while found is not None:
        place, data = found
        unpack, held, number, more = zlib.decompressobj(31), b"", 0, True
        while more:
            held += unpack.decompress(data)
            *whole, held = held.split(MARK)
            for block in whole:
                if number or block.strip():
                    yield place, number, block.decode("utf-8", "replace")
                number += 1
            if unpack.eof:
                break
            data = file.read()
            more = bool(data)
        yield place, number, held.decode("utf-8", "replace")
        rest = unpack.unused_data
        # the next member follows at once; anything else is searched through
        if not rest:
            rest = file.read()
        at = file.at - len(rest)
        if not rest or at >= end:
            return
        while len(rest) < 4096 and (piece := file.read()):
            rest += piece
        if _is_member(rest):
            found = at, rest
        else:
            file.at = at + 1
            found = first_member(file, end)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", 64 << 20))
        self.most, self.least = int(options.get("acceptedperfile", 0)), int(options.get("minchars", 80))

    def partitions(self) -> list[_Range]:
        system, name = fs.FileSystem.from_uri(self.path)
        scheme = self.path.split("://", 1)[0] if "://" in self.path else "file"
        info = system.get_file_info(name)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
        out = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and f.path.endswith(".gz")), key=lambda f: f.path):
            step = f.size if self.most else self.split
            out += [_Range(f"{scheme}://{f.path}", a, min(a + step, f.size)) for a in range(0, f.size, max(1, step))]
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        file, taken = _File(part.path, part.start), 0
        for place, number, block in records(file, part.start, part.end):
            yield part.path, place, number, file.at, block
            taken += self.most > 0 and accepted(block, self.least)
            if self.most and taken >= self.most:
                return


class WebArchive(DataSource):
    """Options: path (a file, or a folder of .gz files), splitBytes, acceptedPerFile (0: all), minChars."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, place bigint, number int, read_to bigint, block string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_archives(spark: SparkSession, path: str, per_file: int | None = None, split_bytes: int = 64 << 20, min_chars: int = 80) -> DataFrame:
    """(block, file, at, read_to) for parse_archive_blocks(): every record, or a file's up to its per_file-th accepted one.

    at orders a file's records; read_to is how far the file had been read then. Paths: what Arrow's file systems open.
    """
    spark.dataSource.register(WebArchive)
    options = {"splitBytes": str(split_bytes), "acceptedPerFile": str(per_file or 0), "minChars": str(min_chars)}
    found = spark.read.format(NAME).options(**options).load(path)
    return found.select("block", "file", F.struct("place", "number").alias("at"), "read_to")


def write_archives(blocks: DataFrame, path: str) -> None:
    """Blocks (block) as files of gzip members under path, one for each partition, whole once they have their names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        name, n = f"{folder}/{uuid.uuid4().hex}.warc.wet.gz", 0
        with system.open_output_stream(f"{name}.writing", compression=None) as out:
            for b in batches:
                for block in b.column(0).to_pylist():
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(pack.compress(MARK + (block or "").encode()) + pack.flush())
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["name", "n"])

    # a file counts if its task does: those of attempts that were lost keep their working name
    for r in blocks.select("block").mapInArrow(run, "name string, n long").collect():
        system, _ = fs.FileSystem.from_uri(path)
        system.move(f"{r['name']}.writing", r["name"])
