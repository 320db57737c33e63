"""Archives of annotation tabs as a data source: one archive is read by many tasks.

``scan_archives(spark, folder)`` gives the lines of all tabs of all ZIP archives below a
folder, as ``isa.archive_lines`` does for archives held in memory. The directory at the end
of an archive tells the size of its members; small ones share a partition, so very many of
them are not a task each, and no archive is ever held in memory.

A compressed member can be unpacked from its start only. A member of several ranges is
unpacked once, by one task, which counts its lines and cuts the text into blocks of whole
ones; the blocks are dealt to as many tasks as there are ranges (``MOST_RANGES`` at most),
which split them into cells. Unpacking and counting is the lesser part of the work, and its
time grows with the member. A line that begins in a block belongs to it, also if a quoted
cell makes it go on beyond, and blocks carry the number of their first line.

``spark.read.format("isa_archives").load(folder)`` gives the same lines, a member to a task.
"""

from __future__ import annotations

import csv
import io
import math
import os
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from assaylens.session import shared_folder
from assaylens.sources import isa

FORMAT = "isa_archives"
RANGE_BYTES = 16 << 20  # unpacked bytes of a range, and of small members that share a partition
MOST_RANGES = 64  # of one member
ARCHIVE_PATTERN = r"([^/]+?)(_metadata_[^/]*)?\.zip$"
_UNREADABLE = (
    zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, pa.ArrowInvalid
)
_BATCH_LINES = 10_000
_BLOCK_CHARACTERS = 1 << 20  # of the text of a large member that goes from task to task
_OPENERS = 16  # archive directories that are read at a time
_ROWS = pa.schema(
    [
        ("accession", pa.string()),
        ("kind", pa.string()),
        ("tab", pa.string()),
        ("line_no", pa.int64()),
        ("cells", pa.list_(pa.string())),
    ]
)
_BLOCK_SCHEMA = "slot bigint, accession string, kind string, tab string, line_no bigint, lines string"
_BLOCKS = pa.schema([("slot", pa.int64()), *list(_ROWS)[:4], ("lines", pa.string())])


@dataclass(frozen=True)
class Range:
    """Lines of a member that begin at or after ``start`` and before ``stop`` (None: the end),
    in characters; or, without a member, why an archive cannot be read."""

    path: str
    accession: str
    member: str | None
    kind: str
    tab: str
    start: int = 0
    stop: int | None = None
    weight: int = 0


class Ranges(InputPartition):
    """Small members, or the ranges of a large one, which begin at ``slot`` among all such ranges."""

    def __init__(self, items: Sequence[Range], slot: int = 0) -> None:
        super().__init__(None)
        self.items = tuple(items)
        self.slot = slot


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/(?!/)", path):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path)


def member_ranges(path: str, accession: str, info: zipfile.ZipInfo, range_bytes: int) -> list[Range]:
    """The ranges of one member; none if it is no tab."""
    found = re.search(isa.MEMBER_PATTERN, os.path.basename(info.filename))
    if not found:
        return []
    # records of an investigation are few, and read as a whole
    n = 1 if found[1] == "i" else min(MOST_RANGES, max(1, math.ceil(info.file_size / range_bytes)))
    width = math.ceil(info.file_size / n)
    return [
        Range(
            path, accession, info.filename, found[1], found[2], k * width, (k + 1) * width if k + 1 < n else None, width
        )
        for k in range(n)
    ]


def packed(ranges: Sequence[Range], range_bytes: int) -> list[Ranges]:
    """Partitions of ranges, neighbours together as long as they are small."""
    out: list[list[Range]] = []
    room = 0
    for item in ranges:
        if not out or item.weight > room:
            out.append([])
            room = range_bytes
        out[-1].append(item)
        room -= item.weight
    return [Ranges(items) for items in out]


def records(text: Iterator[str], start: int, stop: int | None) -> Iterator[tuple[int, list[str]]]:
    """(number, cells) of the lines that begin within a range of characters.

    Comment lines and blank lines are neither given nor numbered.
    """
    at = number = 0
    lines = iter(text)

    def onward(first: str) -> Iterator[str]:
        """A line and, while a quoted cell goes on, those behind it."""
        nonlocal at
        yield first
        for line in lines:
            at += len(line)
            if not line.startswith("#"):
                yield line

    for line in lines:
        begin = at
        at += len(line)
        if stop is not None and begin >= stop:
            return
        if line.startswith("#"):
            continue
        if '"' in line:
            cells = next(csv.reader(onward(line), delimiter="\t", strict=True), None)
        else:
            bare = line.rstrip("\r\n")
            # before the range a line only counts
            cells = bare and ([bare] if begin < start else bare.split("\t"))
        if cells:
            if begin >= start:
                yield number, cells
            number += 1


def blocks(text: io.TextIOBase, size: int) -> Iterator[tuple[int, int, str]]:
    """(character, number, text) of runs of whole lines, of some ``size`` characters each:
    where it begins, the number of its first line, and the lines as they stand."""
    at = number = 0
    while lines := text.readlines(size):
        first, whole = number, "".join(lines)
        if '"' not in whole:
            number += sum(line[0] not in "#\r\n" for line in lines)
        else:
            kept = [line for line in lines if line[0] != "#"]
            left = len(kept)
            beyond: list[str] = []

            def onward() -> Iterator[str]:
                """The lines and, while a quoted cell goes on, those behind them."""
                nonlocal left
                for line in kept:
                    left -= 1
                    yield line
                for line in text:
                    beyond.append(line)
                    if line[0] != "#":
                        yield line

            cells = csv.reader(onward(), delimiter="\t", strict=True)
            while left:
                number += bool(next(cells))
            whole += "".join(beyond)
        yield at, first, whole
        at += len(whole)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self._path = options["path"]
        self._range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self._members = options.get("members", "all")

    def partitions(self) -> list[Ranges]:
        files, root = _filesystem(self._path)
        found = files.get_file_info(root)
        listed = [found] if found.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(i.path for i in listed if i.is_file and re.search(ARCHIVE_PATTERN, i.path))
        with ThreadPoolExecutor(_OPENERS) as pool:
            members = [m for of_one in pool.map(lambda p: self._ranges(files, p), paths) for m in of_one]
        if self._members == "all":
            members = [[replace(m[0], stop=None, weight=sum(r.weight for r in m))] for m in members]
        if self._members != "large":
            return packed([m[0] for m in members if len(m) == 1], self._range_bytes) or [Ranges([])]
        large = [m for m in members if len(m) > 1]
        slots = accumulate((len(m) for m in large), initial=0)
        return [Ranges(m, slot) for m, slot in zip(large, slots)] or [Ranges([])]

    def _ranges(self, files: fs.FileSystem, path: str) -> list[list[Range]]:
        """The ranges of each member of an archive."""
        accession = re.search(ARCHIVE_PATTERN, path)[1]
        try:
            with files.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
                found = [member_ranges(path, accession, i, self._range_bytes) for i in archive.infolist()]
        except _UNREADABLE:
            return [[Range(path, accession, None, isa.BROKEN, "archive cannot be unpacked")]]
        return [m for m in found if m] or [[Range(path, accession, None, isa.BROKEN, "archive has no tabs")]]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(self._path)
        with _long_cells():
            if self._members == "large":
                for row in _blocks_of(files, partition) if partition.items else ():
                    yield _batch([row], _BLOCKS)
            else:
                yield from _batches(row for item in partition.items for row in _range_rows(files, item))


@contextmanager
def _long_cells() -> Iterator[None]:
    """Cells may be as long as they are."""
    before = csv.field_size_limit(2**31 - 1)
    try:
        yield
    finally:
        csv.field_size_limit(before)


def _range_rows(files: fs.FileSystem, item: Range) -> Iterator[tuple]:
    if item.member is None:
        yield item.accession, item.kind, item.tab, 0, None
        return
    tab = (item.accession, item.kind, item.tab)
    try:
        with files.open_input_file(item.path) as raw, zipfile.ZipFile(raw) as archive, archive.open(item.member) as data:
            if item.kind == "i":
                lines = enumerate(isa.tab_lines(data, item.kind))
            else:
                lines = records(_text(data), item.start, item.stop)
            for number, cells in lines:
                yield *tab, number, cells
    except csv.Error:
        yield item.accession, isa.BROKEN, "quotes of a tab do not add up", 0, None
    except _UNREADABLE:
        yield item.accession, isa.BROKEN, "archive cannot be unpacked", 0, None


def _text(data: io.BufferedIOBase) -> io.TextIOWrapper:
    return io.TextIOWrapper(data, errors="replace", newline="", encoding="utf-8")


def _blocks_of(files: fs.FileSystem, partition: Ranges) -> Iterator[tuple]:
    """The blocks of a large member, each with the slot of the range it begins in."""
    item, width = partition.items[0], partition.items[0].weight
    try:
        with files.open_input_file(item.path) as raw, zipfile.ZipFile(raw) as archive, archive.open(item.member) as data:
            for at, number, lines in blocks(_text(data), min(width, _BLOCK_CHARACTERS)):
                yield partition.slot + at // width, item.accession, item.kind, item.tab, number, lines
    except csv.Error:
        yield partition.slot, item.accession, isa.BROKEN, "quotes of a tab do not add up", 0, None
    except _UNREADABLE:
        yield partition.slot, item.accession, isa.BROKEN, "archive cannot be unpacked", 0, None


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of blocks."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*batch.columns):
                *tab, first, lines = (v.as_py() for v in row)
                if lines is None:
                    yield *tab, first, None
                else:
                    for number, cells in records(io.StringIO(lines, newline=""), 0, None):
                        yield *tab, first + number, cells

    with _long_cells():
        yield from _batches(rows())


def _batches(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for row in found:
        rows.append(row)
        if len(rows) == _BATCH_LINES:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _batch(rows: list[tuple], schema: pa.Schema = _ROWS) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class ArchiveSource(DataSource):
    """Lines of archives; options ``path``, ``rangeBytes`` and ``members``: ``small`` ones
    alone, or blocks of the ``large`` ones."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _BLOCK_SCHEMA if self.options.get("members") == "large" else isa.LINE_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def scan_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(accession, kind, tab, line_no, cells) of the archives below a folder, or of one file.

    The folder is opened by every task through ``pyarrow.fs``. An archive that cannot be
    read, or has no tabs, gives rows of the kind ``isa.BROKEN``; the others are read. A
    member of the same kind and name in another folder of an archive adds to the tab.
    """
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format(FORMAT).option("rangeBytes", str(range_bytes))
    small = reader.option("members", "small").load(path)
    tasks = max(MOST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    large = reader.option("members", "large").load(path)
    dealt = large.repartitionById(tasks, F.pmod("slot", F.lit(tasks)).cast("int")).drop("slot")
    return small.unionByName(dealt.mapInArrow(_split, isa.LINE_SCHEMA))


# --- writing ------------------------------------------------------------------------


def _line(cells: Sequence[str | None]) -> str:
    shown = ["" if c is None else c for c in cells]
    plain = "\t".join(shown)
    if plain and not re.search(r'["\r\n]|(^|\t)#', plain) and plain.count("\t") == len(shown) - 1:
        return plain + "\n"
    quoted = [
        '"{}"'.format(c.replace('"', '""')) if re.search(r'["\t\r\n]', c) or c.startswith("#") or shown == [""] else c
        for c in shown
    ]
    return "\t".join(quoted) + "\n"


def _texts(cells: pa.ListArray) -> pa.Array:
    """``_line`` of every row, all at once but for those that need a closer look."""
    if cells.null_count:
        return pa.array([_line(row) for row in cells.to_pylist()], pa.string())
    counts = pc.list_value_length(cells).to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    plain = pc.binary_join(pa.ListArray.from_arrays(ends, pc.fill_null(cells.flatten(), "")), "\t")
    odd = pc.match_substring_regex(plain, '["\\r\\n]|(^|\\t)#').to_numpy(zero_copy_only=False)
    odd = odd | (pc.binary_length(plain).to_numpy(zero_copy_only=False) == 0)
    odd = odd | (pc.count_substring(plain, "\t").to_numpy(zero_copy_only=False) != counts - 1)
    out = pc.binary_join_element_wise(plain, "", "\n")
    if odd.any():
        looked = [_line(cells[k].as_py()) for k in np.flatnonzero(odd).tolist()]
        out = pc.replace_with_mask(out, pa.array(odd), pa.array(looked, pa.string()))
    return out


_PART_FIELDS = [
    ("accession", pa.string()), ("kind", pa.string()), ("tab", pa.string()), ("task", pa.int64()),
    ("path", pa.string()), ("at", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()),
    ("crc", pa.int64()), ("n_lines", pa.int64()),
]
_PART_SCHEMA = (
    "accession string, kind string, tab string, task bigint, path string, at bigint, packed bigint, size bigint, "
    "crc bigint, n_lines bigint"
)


def write_archives(lines: DataFrame, folder: str) -> DataFrame:
    """Write the lines of tabs as one archive each accession; gives (accession, path, n_lines).

    Lines are sorted over all tasks, so that those of one archive are spread as well. A task
    holds the lines of a batch at a time, in the order of ``line_no``, and packs them into
    parts that can stand one behind the other; an archive is put together from its parts
    without packing them again. It gets its name once it is complete, so a task that is run
    again leaves the same file. Lines of a quoted cell that begin with ``#`` are comments
    to all readers and are not kept.
    """
    shared_folder(lines.sparkSession)
    columns = ["accession", "kind", "tab", "line_no", "cells"]
    key = columns[:-1]
    ordered = lines.select(*columns).repartitionByRange(*key).sortWithinPartitions(*key)
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    place = f".parts-{uuid.uuid4().hex[:12]}"
    files.create_dir(f"{root}/{place}")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        context = TaskContext.get()
        path = f"{root}/{place}/{context.partitionId()}-{context.taskAttemptId()}"
        with files.open_output_stream(path) as raw:
            parts = _Parts(raw)
            for batch in batches:
                texts, at = _texts(batch.column(4)), 0
                for tab, own in groupby(zip(*(batch.column(n).to_pylist() for n in (0, 1, 2)))):
                    n = sum(1 for _ in own)
                    parts.add(tab, texts.slice(at, n))
                    at += n
            parts.close()
        done = [(*tab, context.partitionId(), path, *figures) for tab, *figures in parts.done]
        yield _batch(done, pa.schema(_PART_FIELDS))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        for batch in batches:
            for accession, parts in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{root}/{accession}.zip"
                partial = f"{root}/.{accession}-{os.getpid()}.partial"
                with files.open_output_stream(partial) as raw:
                    _join_parts(files, raw, parts)
                files.move(partial, path)
                done = [(accession, path, sum(p["n_lines"] for p in parts))]
                yield _batch(done, pa.schema([("accession", pa.string()), ("path", pa.string()), ("n_lines", pa.int64())]))

    parts = ordered.mapInArrow(pack, _PART_SCHEMA).checkpoint()
    own = F.struct(*[name for name, _ in _PART_FIELDS[1:]])
    archives = parts.groupBy("accession").agg(F.sort_array(F.collect_list(own)).alias("parts"))
    written = archives.mapInArrow(join, "accession string, path string, n_lines bigint").checkpoint()
    files.delete_dir(f"{root}/{place}")
    return written


class _Parts:
    """Packs the lines of tabs, one tab after another, into a stream.

    What is packed of a tab ends at a byte and looks back at nothing, so that it can
    follow another part of the tab in one member.
    """

    def __init__(self, raw) -> None:
        self._raw = raw
        self._tab = self._packer = None
        self._at = 0
        self.done: list[tuple] = []  # (tab, at, packed, size, crc, n_lines)

    def add(self, tab: tuple, lines: pa.Array) -> None:
        if self._packer is None or tab != self._tab:
            self.close()
            self._tab = tab
            self._packer = zlib.compressobj(wbits=-zlib.MAX_WBITS)
            self._packed = self._size = self._crc = self._n = 0
        whole = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines)
        data = pc.binary_join(whole, "")[0].as_buffer()
        self._put(self._packer.compress(data))
        self._size += len(data)
        self._crc = zlib.crc32(data, self._crc)
        self._n += len(lines)

    def _put(self, data: bytes) -> None:
        self._raw.write(data)
        self._packed += len(data)

    def close(self) -> None:
        if self._packer is None:
            return
        self._put(self._packer.flush(zlib.Z_FULL_FLUSH))
        self.done.append((self._tab, self._at, self._packed, self._size, self._crc, self._n))
        self._at += self._packed
        self._packer = None


def _joined_crc(first: int, second: int, length: int) -> int:
    """The checksum of two texts, one behind the other, by theirs and the length of the second."""
    zeros = bytes(min(length, 1 << 20))
    none = 0
    while length:
        some = zeros[:length]
        first, none = zlib.crc32(some, first), zlib.crc32(some, none)
        length -= len(some)
    return first ^ none ^ second


def _join_parts(files: fs.FileSystem, raw, parts: Sequence[dict]) -> None:
    """An archive of parts, which are sorted by tab and then by their place in it."""
    end = zlib.compressobj(wbits=-zlib.MAX_WBITS).flush()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
        for (kind, tab), own in groupby(parts, key=lambda p: (p["kind"], p["tab"])):
            own = list(own)
            member = zipfile.ZipInfo(f"{kind}_{tab}.txt")
            member.compress_type = zipfile.ZIP_DEFLATED
            member.file_size = sum(p["size"] for p in own)
            member.compress_size = sum(p["packed"] for p in own) + len(end)
            member.CRC = 0
            for part in own:
                member.CRC = _joined_crc(member.CRC, part["crc"], part["size"])
            member.header_offset = archive.fp.tell()
            archive.fp.write(member.FileHeader())
            for part in own:
                with files.open_input_file(part["path"]) as packed_text:
                    packed_text.seek(part["at"])
                    left = part["packed"]
                    while left:
                        data = packed_text.read(min(left, 1 << 20))
                        archive.fp.write(data)
                        left -= len(data)
            archive.fp.write(end)
            # the directory is written from these as the archive is closed
            archive.filelist.append(member)
            archive.NameToInfo[member.filename] = member
            archive.start_dir = archive.fp.tell()
            archive._didModify = True
