"""Python data source `pagefile`: packets of containers on a mounted file system, as a batch or a stream.

    spark.dataSource.register(PageFileSource)
    spark.read.format("pagefile").option("splitBytes", 64 << 20).load(folder)

Partitions are ranges of bytes; the driver lists files and their sizes and reads
none. A range's pages are those that begin in it: its task looks for the first
one by magic, limits and checksum and walks from there. No range reads what lies
behind the pages: where a file ends with an asset bundle or a seek index, their
footers say where that begins. A damaged page ends the walk of its range (with
mode "strict" it is an error); the next range finds the next whole page.

As a stream, the folder's files are taken in order of time and name, each once.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from reelspark.sources.container import (
    BUNDLE_MAGIC,
    FLAG_CRC,
    INDEX_FOOTER,
    INDEX_FOOTER_MAGIC,
    INDEX_FOOTER_VERSION,
    MAX_FIRST,
    MAX_PACKETS,
    MAX_PAYLOAD,
    PACKETS,
    PAGE,
    PAGE_FORMAT,
    PAGE_MAGIC,
    _packet_rows,
    arrow_schema,
    first_page,
    packets_of,
)

BUNDLE_FOOTER, LOOK = 64, 1 << 20


def _files(options) -> list[tuple[int, str, int]]:
    """(time, name, size) of the files, in order of time and name."""
    path = options["path"].removeprefix("file://")
    if os.path.isdir(path):
        with os.scandir(path) as found:
            entries = [(e.stat(), e.path) for e in found if e.is_file() and not e.name.startswith(("_", "."))]
    else:
        entries = [(os.stat(path), path)]
    return sorted((stat.st_mtime_ns, name, stat.st_size) for stat, name in entries)


class Run(InputPartition):
    """The pages of a file that begin from one byte up to another."""

    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


def ranges(files: list[tuple[int, str, int]], options) -> list[Run]:
    split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
    return [Run(name, at, min(at + split, size)) for _, name, size in files for at in range(0, size, split)]


def pages_end(read: Callable[[int, int], bytes], size: int) -> int:
    """Where the pages end, by the footers of what may stand behind them."""
    while True:
        foot = read(max(size - BUNDLE_FOOTER, 0), BUNDLE_FOOTER)
        before = None
        if len(foot) == BUNDLE_FOOTER and foot[:4] == BUNDLE_MAGIC:
            before = struct.unpack_from("<Q", foot, 8)[0]
        elif len(foot) >= INDEX_FOOTER and struct.unpack_from("<II", foot, len(foot) - INDEX_FOOTER) == (INDEX_FOOTER_MAGIC, INDEX_FOOTER_VERSION):
            before = struct.unpack_from("<Q", foot, len(foot) - INDEX_FOOTER + 8)[0]
        if before is None or not 0 < before < size:
            return size
        size = before


def next_page(read: Callable[[int, int], bytes], at: int, stop: int, size: int) -> int | None:
    """The first whole page that begins in at .. stop."""
    while at < stop:
        window = read(at, min(LOOK, size - at))
        place = window.find(PAGE_MAGIC)
        while place >= 0 and at + place < stop:
            head = window[place : place + PAGE]
            if len(head) < PAGE:
                head = read(at + place, PAGE)
            if len(head) == PAGE:
                _, length, flags, _, _, payload, count, _, crc, _ = struct.unpack(PAGE_FORMAT, head)
                if length == PAGE and flags & FLAG_CRC and 0 < payload <= MAX_PAYLOAD and 0 < count <= MAX_PACKETS and at + place + PAGE + payload <= size and zlib.crc32(read(at + place + PAGE, payload)) == crc:
                    return at + place
            place = window.find(PAGE_MAGIC, place + 1)
        at += max(len(window) - 1, 1)  # a magic may lie across two windows
    return None


def _read(run: Run, options):
    with open(run.file, "rb") as f:

        def part(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        end = pages_end(part, os.fstat(f.fileno()).st_size)
        start = first_page(part(0, MAX_FIRST)) if run.start == 0 else next_page(part, run.start, min(run.stop, end), end)
        if start is None or start >= run.stop:
            if run.start or start is None:
                return
        body = options.get("body")
        packets = packets_of(part, end, start, options.get("mode") == "strict", None if body is None else int(body), run.stop)
        yield from _packet_rows(run.file, packets, arrow_schema(PACKETS))


class PageFileReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return ranges(_files(self.options), self.options)

    def read(self, partition: Run):
        yield from _read(partition, self.options)


class PageFileStream(DataSourceStreamReader):
    """The offset is time and name of the last file taken; files must be complete when they appear, and not older than those taken."""

    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.options)
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        after, upto = ((o["time"], o["name"]) for o in (start, end))
        return ranges([f for f in _files(self.options) if after < f[:2] <= upto], self.options)

    def read(self, partition: Run):
        yield from _read(partition, self.options)

    def commit(self, end: dict) -> None:
        pass


class PageFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagefile"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema):
        return PageFileReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return PageFileStream(self.options)
