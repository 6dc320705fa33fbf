"""A streaming source of numbered lines: the files of a folder, read by byte ranges as they grow."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source string, line_no bigint, value string"
FILE_BYTES = 256 << 20        # of one file in one trigger
BLOCK_BYTES = 32 << 20        # of one task
BUFFER = 1 << 20
ROWS = 10_000                 # lines of one Arrow batch
BOM = b"\xef\xbb\xbf"


@dataclass
class Range(InputPartition):
    """One task: the pieces between line feeds that start in [``cut``, ``until``) of an admitted range [``begin``, ``end``)."""

    path: str
    begin: int
    end: int
    cut: int
    until: int
    open_ends: int


class LineCounter:
    """Counts lines in consecutive pieces of bytes; a line ends at LF, CR or CR LF, wherever the pieces were cut."""

    def __init__(self):
        self.ends, self.last = 0, b""

    def add(self, data: bytes) -> None:
        if not data:
            return
        self.ends += data.count(b"\n") + data.count(b"\r") - data.count(b"\r\n")
        if self.last == b"\r" and data[:1] == b"\n":
            self.ends -= 1
        self.last = data[-1:]


class LineReader(DataSourceStreamReader):
    """Offsets are ``{file: [bytes read, ends without a line end]}``.

    The driver only lists files and looks for the last line feed of those that
    grew; lines are read and counted in the tasks.  What ``state`` holds is a
    help, never the truth: the offset handed out last (so a restarted query
    admits from there) and line counts at range ends.  A lost count is worked
    out again from the file.
    """

    def __init__(self, options):
        self.root = options["path"]
        self.state = options["state"].rstrip("/")
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        self.block_bytes = int(options.get("blockbytes", BLOCK_BYTES))
        self.max_files = int(options.get("maxfiles", 1000))
        self.quiet = float(options.get("quietseconds", 10))
        self.given = None

    # -- the driver's part ------------------------------------------------

    def initialOffset(self) -> dict:
        return {}

    def _last(self) -> dict:
        if self.given is None:
            fs, folder = open_fs(self.state)
            fs.create_dir(folder)
            self.given = json.loads(read_small(fs, f"{folder}/offset") or "{}")
        return self.given

    def latestOffset(self) -> dict:
        import time

        given, now = self._last(), time.time()
        fs, folder = open_fs(self.root)
        offset, grown = dict(given), 0
        for info in sorted(fs.get_file_info(arrow_fs.FileSelector(folder)), key=lambda i: i.path):
            if info.type != arrow_fs.FileType.File or info.base_name[:1] in "._":
                continue
            at, open_ends = given.get(info.path, (0, 0))
            if info.size <= at or grown >= self.max_files:
                continue
            silent = info.mtime_ns is not None and now - info.mtime_ns / 1e9 >= self.quiet
            end, is_open = admit(fs, info.path, at, info.size, self.file_bytes, silent)
            if end > at:
                offset[info.path] = [end, open_ends + is_open]
                grown += 1
        if offset != given:
            state_fs, state = open_fs(self.state)
            write_small(state_fs, f"{state}/offset", json.dumps(offset))
            self.given = offset
        return offset

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (stop, _) in sorted(end.items()):
            begin, open_ends = start.get(path, (0, 0))
            out += [Range(path, begin, stop, cut, min(cut + self.block_bytes, stop), open_ends)
                    for cut in range(begin, stop, self.block_bytes)]
        return out

    def commit(self, end: dict) -> None:
        pass

    # -- the tasks' part --------------------------------------------------

    def read(self, part: Range):
        import pyarrow as pa

        fs, _ = open_fs(self.root)
        source = source_prefix(self.root) + part.path
        state_fs, state = open_fs(self.state)
        base = lines_before(fs, part, state_fs, state) + part.open_ends
        with fs.open_input_file(part.path) as f:
            at = piece_start(f, part)
            counter = LineCounter()
            for data in chunks(f, part.begin, at):
                counter.add(data)
            number, ended = base + counter.ends, LineCounter()
            texts = []
            for piece in pieces(f, at, part.until, part.end):
                ended.add(piece)
                if at == 0 and piece.startswith(BOM):
                    piece = piece[len(BOM):]
                at = -1
                texts += piece.splitlines()
                while len(texts) >= ROWS:
                    yield batch(pa, source, number, texts[:ROWS])
                    number, texts = number + ROWS, texts[ROWS:]
            if texts:
                yield batch(pa, source, number, texts)
        if part.until == part.end:
            write_small(state_fs, f"{state}/{count_name(part.path, part.end)}", str(base - part.open_ends + counter.ends + ended.ends))


def batch(pa, source: str, number: int, texts: list[bytes]):
    return pa.RecordBatch.from_arrays(
        [pa.array([source] * len(texts), pa.string()), pa.array(range(number, number + len(texts)), pa.int64()),
         pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["source", "line_no", "value"])


def open_fs(path: str):
    """The file system of a path or URI, and the path inside it."""
    if "://" not in path:
        return arrow_fs.LocalFileSystem(), path.removeprefix("file:")
    return arrow_fs.FileSystem.from_uri("s3://" + path[6:] if path.startswith("s3a://") else path)


def source_prefix(root: str) -> str:
    """What the batch scan puts before a path inside the file system."""
    _, inner = open_fs(root.rstrip("/"))
    plain = root.rstrip("/").removesuffix(inner.rstrip("/"))
    return plain if "://" in plain and not plain.startswith("file:") else "file:"


def read_small(fs, path: str) -> str | None:
    try:
        with fs.open_input_file(path) as f:
            return f.read().decode()
    except FileNotFoundError:
        return None


def write_small(fs, path: str, text: str) -> None:
    """Appears whole or not at all; a repeated task writes the same content."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as f:
        f.write(text.encode())
    fs.move(part, path)


def admit(fs, path: str, at: int, size: int, limit: int, silent: bool) -> tuple[int, int]:
    """(end of the range to read now, 1 if it ends without a line feed).

    A range ends after the last line feed within ``limit`` bytes, or after the
    first one beyond.  A file that was silent long enough is read to its end.
    """
    stop = min(size, at + limit)
    with fs.open_input_file(path) as f:
        hi = stop
        while hi > at:
            lo = max(at, hi - BUFFER)
            found = f.read_at(hi - lo, lo).rfind(b"\n")
            if found >= 0:
                last = lo + found + 1
                # the rest of a silent file goes along when it is within the limit
                return (size, 1) if silent and stop == size and last < size else (last, 0)
            hi = lo
        while stop < size:
            data = f.read_at(min(BUFFER, size - stop), stop)
            found = data.find(b"\n")
            if found >= 0:
                return stop + found + 1, 0
            stop += len(data)
        if not silent:
            return at, 0
        return size, int(f.read_at(1, size - 1) != b"\r")


def chunks(f, begin: int, end: int):
    while begin < end:
        data = f.read_at(min(BUFFER, end - begin), begin)
        if not data:
            return
        yield data
        begin += len(data)


def piece_start(f, part: Range) -> int:
    """The first position from ``cut`` on that follows a line feed (or begins the range)."""
    if part.cut == part.begin:
        return part.cut
    at = part.cut - 1
    for data in chunks(f, at, part.end):
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return part.end


def pieces(f, at: int, until: int, end: int):
    """Bytes from ``at``, cut after line feeds, up to the first line feed at or after ``until`` - 1."""
    rest = b""
    while at < until:
        data = f.read_at(min(BUFFER, until - at), at)
        if not data:
            break
        at += len(data)
        whole, feed, tail = data.rpartition(b"\n")
        if feed:
            yield rest + whole + feed
            rest = tail
        else:
            rest += data
    if not rest:
        return
    held = [rest]
    for data in chunks(f, at, end):                  # a line under way is finished
        found = data.find(b"\n")
        held.append(data if found < 0 else data[:found + 1])
        if found >= 0:
            break
    yield b"".join(held)


def count_name(path: str, at: int) -> str:
    return f"count-{hashlib.sha256(path.encode()).hexdigest()[:32]}-{at}"


def lines_before(fs, part: Range, state_fs, state: str) -> int:
    """Line ends before the range: as noted by the task that read up to there, else counted."""
    if part.begin == 0:
        return 0
    noted = read_small(state_fs, f"{state}/{count_name(part.path, part.begin)}")
    if noted is not None:
        return int(noted)
    counter = LineCounter()
    with fs.open_input_file(part.path) as f:
        for data in chunks(f, 0, part.begin):
            counter.add(data)
    return counter.ends


class LineSource(DataSource):
    """``spark.readStream.format("numbered_lines")`` with ``path`` and ``state``; see ``stream_lines``."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options)


def stream_lines(spark: SparkSession, path: str, state: str, max_files: int = 1000, file_bytes: int = FILE_BYTES,
                 block_bytes: int = BLOCK_BYTES, quiet_seconds: float = 10) -> DataFrame:
    """``source, line_no, value`` of the files of a folder as they appear and grow.

    ``line_no`` is the 0-based number of a line in its file: the same that
    ``number_lines`` gives in batch, whatever the triggers, blocks, retries and
    restarts.  A trigger admits up to ``max_files`` files that grew and about
    ``file_bytes`` of each, in tasks of ``block_bytes``.  A last line without
    line end waits until the file is silent for ``quiet_seconds``; what is
    appended to it later counts as a line of its own.  Empty files and folders
    give no rows, bad bytes are replaced, names that begin with ``.`` or ``_``
    are passed over.  A file may grow or be deleted when read, but not shrink
    or change its name.  A block holds one line of any length in memory.

    ``state`` is a folder of this query alone that all executors share, beside
    its checkpoint.  The offset holds an entry per file, so move old files
    away from folders that gain millions.
    """
    spark.dataSource.register(LineSource)
    return (spark.readStream.format("numbered_lines").option("path", path).option("state", state)
            .option("maxfiles", max_files).option("filebytes", file_bytes).option("blockbytes", block_bytes)
            .option("quietseconds", quiet_seconds).load())
