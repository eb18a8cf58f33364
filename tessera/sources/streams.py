"""Sources that cut a file by bytes: NDJSON as a stream with offsets, and PBF extracts by blob."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a partition; bytes before an offset whose digest tells whether a file is still the one that was read; bytes read at once.
SPLIT, TAIL, READ = 16 << 20, 4096, 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it: a local path or any address that Arrow knows (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_at(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of the files of a folder, in order of their names."""
    store, at = opened(path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(suffix) and not x.base_name.startswith((".", "_")))


class Span(InputPartition):
    """Bytes [start, end) of a file."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


def lines_of(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end), where start is 0 or behind any line break: the line that a span
    begins within belongs to the span before."""
    at = start
    if start:
        stream.seek(start - 1)
        left, at = b"", start - 1
        while b"\n" not in left:
            more = stream.read(READ)
            if not more:
                return
            at += len(left)
            left = more
        cut = left.index(b"\n") + 1
        at, left = at + cut, left[cut:]
    else:
        stream.seek(0)
        left = b""
    parts: list[bytes] = [left]
    while at < end:
        head, found, rest = parts[-1].partition(b"\n")
        if found:
            line = b"".join([*parts[:-1], head])
            yield at, line
            at, parts = at + len(line) + 1, [rest]
            continue
        more = stream.read(READ)
        if not more:
            if line := b"".join(parts):
                yield at, line
            return
        parts.append(more)


class NdjsonStream(DataSource):
    """The lines of the files at option `path` as they grow: file, at (the byte at which a line begins), line, and sha256 of the line.

    A batch takes whole lines only: what stands behind the last line break waits for the rest. The stream's checkpoint holds, for each
    file, how many bytes were read and a digest of the TAIL bytes that were read last. A restart goes on at that byte; if the
    bytes before it aren't those that were read, the stream stops with an error rather than skip or repeat lines. Files are cut into spans of option
    `split` bytes. Blank lines are left out; bytes that aren't UTF-8 are replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "ndjson_offsets"

    def schema(self) -> str:
        return "file string, at long, line string, sha256 string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return NdjsonReader(self.options)


class NdjsonReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self._seen: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """How far each file has whole lines. Only its end is read: from the last byte back to the last line break."""
        store, out = opened(self.path)[0], {}
        for path, size in files_at(self.path):
            known = self._seen.get(path, [0, 0, ""])
            if known[1] == size:
                out[path] = known
                continue
            with store.open_input_file(path) as f:
                end = size
                while end > 0:
                    f.seek(max(0, end - READ))
                    block = f.read(end - max(0, end - READ))
                    if (cut := block.rfind(b"\n")) >= 0:
                        end = end - len(block) + cut + 1
                        break
                    end -= len(block)
                out[path] = [end, size, self._tail(f, end)]
        self._seen = dict(out)
        return {"files": out}

    @staticmethod
    def _tail(f, end: int) -> str:
        f.seek(max(0, end - TAIL))
        return hashlib.sha256(b"%d:" % end + f.read(min(end, TAIL))).hexdigest()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        store, out = opened(self.path)[0], []
        for path, (to, _, _) in sorted(end["files"].items()):
            at, _, digest = start["files"].get(path, [0, 0, ""])
            if at:
                with store.open_input_file(path) as f:
                    if f.size() < at or self._tail(f, at) != digest:
                        raise ValueError(f"{path} isn't the file that was read up to byte {at}")
            out += [Span(path, x, min(x + self.split, to)) for x in range(at, to, self.split)]
        return out

    def read(self, part: Span) -> Iterator[tuple]:
        with opened(self.path)[0].open_input_file(part.path) as f:
            for at, line in lines_of(f, part.start, part.end):
                if line.strip():
                    yield part.path, at, line.decode("utf-8", "replace"), hashlib.sha256(line).hexdigest()

    def commit(self, end: dict) -> None:
        pass


def ndjson_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """A streaming DataFrame of NdjsonStream."""
    spark.dataSource.register(NdjsonStream)
    return spark.readStream.format("ndjson_offsets").option("path", path).option("split", str(split)).load()


class PbfSource(DataSource):
    """The elements of PBF extracts at option `path`. The driver reads the headers of the blobs alone, and makes partitions of
    neighbouring blobs of about `split` bytes; a task reads and decodes one blob after the other, so its memory is one blob's."""

    @classmethod
    def name(cls) -> str:
        return "osm_blobs"

    def schema(self) -> str:
        from .pbf import DDL

        return DDL

    def reader(self, schema) -> DataSourceReader:
        return PbfReader(self.options)


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Span]:
        store, out = opened(self.path)[0], []
        for path, size in files_at(self.path):
            with store.open_input_file(path) as f:
                first = at = 0
                for _, end in blob_ends(f, size):
                    if end - first >= self.split:
                        out.append(Span(path, first, end))
                        first = end
                    at = end
                if at > first:
                    out.append(Span(path, first, at))
        return out or [Span("", 0, 0)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        from . import pbf

        if not part.path:
            return
        with opened(self.path)[0].open_input_file(part.path) as f:
            at = part.start
            while at < part.end:
                f.seek(at)
                head = int.from_bytes(f.read(4), "big")
                size = 4 + head + dict(pbf.fields(f.read(head)))[3]
                f.seek(at)
                for block in pbf.blobs(f.read(size)):
                    rows = list(pbf.elements_of(block))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), pbf._SCHEMA, strict=True)], schema=pbf._SCHEMA)
                at += size


def blob_ends(f, size: int) -> Iterator[tuple[int, int]]:
    """Where each blob of a file begins and ends, from their headers; a cut-off end is left out."""
    from . import pbf

    at = 0
    while at + 4 <= size:
        f.seek(at)
        head = int.from_bytes(f.read(4), "big")
        if at + 4 + head > size:
            return
        end = at + 4 + head + dict(pbf.fields(f.read(head)))[3]
        if end > size:
            return
        yield at, end
        at = end


def pbf_elements(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """As pbf.elements(), a file over many tasks. For stores that only Spark reads, use that one."""
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_blobs").option("path", path).option("split", str(split)).load()

