"""Objects of large JSON lists, read in parallel from byte ranges of one file.

A file is a list of objects, or an object that holds the list under one key. What a byte means depends on all bytes before
it: whether it stands inside a string, and how deep. So a file is read twice, both times in ranges that are tasks of their own.

The first pass sums every range up, once for either answer to "does it begin inside a string": how many quotes, how far
the depth moves, how many objects open at which depth relative to the range's start. From these sums, a few numbers a
range, follow every range's true state and how many records lie before it. The second pass reads, from each range, the records that
begin there, each to its end wherever that is. Each comes as its text with its position in the file.

Both passes are a Spark data source: plain ``spark.read.format("json_list")`` works as well, a file a task, and as a stream it
picks up new files. Encoded in UTF-8, with or without a byte order mark. Anything that isn't such a list is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE = 64 << 20  # bytes
BATCH = 2_048  # records of one Arrow batch
SPACE = b" \t\r\n"
MARK = b"\xef\xbb\xbf"
MESSAGE = "a JSON file holds a list of postings, or an object with such a list under its key"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Bytes:
    """Random access to one file, block by block."""

    def __init__(self, path: str) -> None:
        system, name = _open(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()

    def read(self, start: int, end: int) -> bytes:
        start, end = max(0, start), min(end, self.size)
        return self.file.read_at(end - start, start) if end > start else b""

    def escaped(self, at: int) -> bool:
        """Whether the byte ``at`` follows an odd number of backslashes."""
        run, step = 0, 64
        while True:
            before = self.read(at - run - step, at - run)
            tail = len(before) - len(before.rstrip(b"\\"))
            run += tail
            if tail < len(before) or not before:
                return run % 2 == 1
            step *= 2


@dataclass
class Marks:
    """The bytes of one range that matter: unescaped quotes, and the brackets with the number of quotes before each."""

    quotes: np.ndarray
    brackets: np.ndarray
    kinds: np.ndarray
    before: np.ndarray

    def outside(self, in_string: bool, depth: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and kinds of the brackets outside strings, and the depth before each."""
        real = self.before % 2 == int(in_string)
        kinds = self.kinds[real]
        moves = np.where((kinds == ord("{")) | (kinds == ord("[")), 1, -1)
        return self.brackets[real], kinds, depth + np.cumsum(moves) - moves


def marks(data: bytes, first_escaped: bool = False) -> Marks:
    seen = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(seen == ord('"'))
    if b"\\" in data or first_escaped:
        free = []
        for q in quotes[(quotes == 0) | (seen[np.maximum(quotes - 1, 0)] == ord("\\"))].tolist():
            run = 0
            while run < q and seen[q - 1 - run] == ord("\\"):
                run += 1
            if (run + (first_escaped and run == q)) % 2:
                free.append(q)
        quotes = np.setdiff1d(quotes, np.array(free, quotes.dtype), assume_unique=True)
    brackets = np.flatnonzero((seen == ord("{")) | (seen == ord("}")) | (seen == ord("[")) | (seen == ord("]")))
    return Marks(quotes, brackets, seen[brackets], np.searchsorted(quotes, brackets))


def sums(data: bytes, first_escaped: bool) -> dict:
    """What the first pass tells of a range, for a start outside and for one inside a string."""
    found = marks(data, first_escaped)
    starts = []
    for in_string in (False, True):
        _, kinds, depth = found.outside(in_string)
        levels, counts = np.unique(depth[kinds == ord("{")], return_counts=True)
        opened = int(np.sum((kinds == ord("{")) | (kinds == ord("["))))
        after = depth + np.where((kinds == ord("{")) | (kinds == ord("[")), 1, -1)
        starts.append({"moved": 2 * opened - len(kinds), "low": int(after.min(initial=0)), "objects": {int(d): int(c) for d, c in zip(levels, counts)}})
    return {"quotes": len(found.quotes) % 2, "starts": starts}


@dataclass
class Range(InputPartition):
    """A byte range of a file and the state it begins in."""

    path: str
    start: int
    end: int
    level: int = 0  # depth of the records: 1 in a list, 2 in a list under a key
    in_string: bool = False
    depth: int = 0
    inside: bool = False  # whether the list of records is open
    number: int = 0  # records of all files before it


def _fail() -> None:
    raise ValueError(MESSAGE)


def _key_before(source: Bytes, at: int) -> str | None:
    """The object key whose value begins at ``at``."""
    head = source.read(at - 4_096, at).rstrip(SPACE)
    if not head.endswith(b":"):
        return None
    head = head[:-1].rstrip(SPACE)
    quotes = marks(head, source.escaped(max(0, at - 4_096))).quotes
    return json.loads(head[quotes[-2] :]) if len(quotes) > 1 and head.endswith(b'"') else None


def _spans(source: Bytes, part: Range, key: str, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int, bool]]:
    """``(begin, end, opened)``: the stretches of the range that lie inside the list of records, and whether one opens there."""
    places, kinds, depth = found
    edge = np.flatnonzero(((kinds == ord("[")) & (depth == part.level - 1)) | ((kinds == ord("]")) & (depth == part.level)))
    spans, begin, opened = [], part.start if part.inside else -1, False
    for i in edge.tolist():
        at = part.start + int(places[i])
        if kinds[i] == ord("[") and (part.level == 1 or _key_before(source, at) == key):
            begin, opened = at + 1, True
        elif kinds[i] == ord("]") and begin >= 0:
            spans.append((begin, at, opened))
            begin, opened = -1, False
    if begin >= 0:
        spans.append((begin, part.end, opened))
    return spans


def _level(source: Bytes) -> int:
    head = source.read(0, 1 << 16)
    head = head.removeprefix(MARK).lstrip(SPACE)
    if head[:1] not in (b"[", b"{"):
        _fail()
    return 1 if head[:1] == b"[" else 2


def edges(source: Bytes, part: Range, key: str) -> dict:
    """What a range does to the list of records: the records in a list that was open before, the others, and whether one is open at the end."""
    data = source.read(part.start, part.end)
    found = marks(data, source.escaped(part.start)).outside(part.in_string, part.depth)
    places = part.start + found[0][(found[1] == ord("{")) & (found[2] == part.level)]
    counts = {True: [0, 0, False], False: [0, 0, False]}
    for inside, out in counts.items():
        part.inside = inside
        for begin, end, opened in _spans(source, part, key, found):
            n = int(np.sum((places >= begin) & (places < end)))
            out[0], out[1], out[2] = out[0] + n, out[1] + opened, end == part.end and not _closes(found, end - part.start)
    return {str(int(i)): c for i, c in counts.items()}


def _closes(found: tuple[np.ndarray, np.ndarray, np.ndarray], at: int) -> bool:
    i = int(np.searchsorted(found[0], at))
    return i < len(found[0]) and found[0][i] == at and found[1][i] == ord("]")


def _record_end(source: Bytes, start: int) -> int:
    """The place after the object that opens at ``start``."""
    step = 1 << 16
    while True:
        places, kinds, depth = marks(source.read(start, start + step)).outside(False)
        ends = places[(kinds == ord("}")) & (depth == 1)]
        if len(ends):
            return start + int(ends[0]) + 1
        if start + step >= source.size:
            _fail()
        step *= 4


def records_of(source: Bytes, part: Range, key: str) -> Iterator[bytes]:
    """The records that begin in the range; ``part`` is left in the state in which the next range begins."""
    data = source.read(part.start, part.end)
    seen = marks(data, source.escaped(part.start))
    found = seen.outside(part.in_string, part.depth)
    places, kinds, depth = found
    after = depth + np.where((kinds == ord("{")) | (kinds == ord("[")), 1, -1)
    if len(after) and after.min() < 0:
        _fail()
    rest = data if not len(places) else data[int(places[-1]) + 1 :]
    if (after[-1] if len(after) else part.depth) == 0 and part.end > 0 and (len(after) or part.start) and rest.strip(SPACE + MARK):
        _fail()  # something follows the list
    opens = part.start + places[(kinds == ord("{")) & (depth == part.level)]
    closes = part.start + places[(kinds == ord("}")) & (depth == part.level + 1)]
    spans = _spans(source, part, key, found)
    for begin, end, opened in spans:
        starts = opens[(opens >= begin) & (opens < end)].tolist()
        ends = closes[(closes >= begin) & (closes < end)].tolist()
        between = begin if opened or part.depth == part.level and not part.in_string else -1  # where bytes outside records begin
        if ends and (not starts or ends[0] < starts[0]):
            between = ends.pop(0) + 1
        for i, start in enumerate(starts):
            if data[between - part.start : start - part.start].strip(SPACE) not in ((b",", b"") if between == begin else (b",",)):
                _fail()
            stop = ends[i] + 1 if i < len(ends) else _record_end(source, start)
            yield data[start - part.start : stop - part.start] if stop <= part.end else source.read(start, stop)
            between = stop
        if 0 <= between < end and data[between - part.start : end - part.start].strip(SPACE) not in (b"", b","):
            _fail()
    part.inside = bool(spans) and spans[-1][1] == part.end and not _closes(found, part.end - part.start)
    part.in_string ^= bool(len(seen.quotes) % 2)
    part.depth = int(after[-1]) if len(after) else part.depth
    if part.end >= source.size and (part.depth or part.in_string):
        _fail()
    part.start = part.end


def _batches(records: Iterator[bytes], number: int, path: str) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []

    def made() -> pa.RecordBatch:
        at = range(number - len(held) + 1, number + 1)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([h.decode() for h in held], pa.string()), pa.array([path] * len(held), pa.string())], names=["record_no", "value", "file"])

    for record in records:
        held.append(record)
        number += 1
        if len(held) == BATCH:
            yield made()
            held = []
    if held:
        yield made()


def _whole(path: str, key: str, size: int) -> Iterator[bytes]:
    """All records of one file, range by range."""
    source = Bytes(path)
    part = Range(path, 0, 0, _level(source))
    opened = False
    for start in range(0, source.size, size):
        part.start, part.end = start, min(source.size, start + size)
        before = part.inside
        for record in records_of(source, part, key):
            opened = True
            yield record
        opened |= before or part.inside
    if not opened and not _has_list(source, part.level, key):
        _fail()


def _has_list(source: Bytes, level: int, key: str) -> bool:
    """Whether a file without records holds an empty list in the right place."""
    whole = json.loads(source.read(0, source.size).removeprefix(MARK))
    return whole == [] if level == 1 else isinstance(whole.get(key), list)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, sums_only: bool) -> None:
        self.options, self.sums_only = options, sums_only
        self.key = options.get("key", "jobs")
        self.size = int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[Range]:
        if "ranges" in self.options:
            return [Range(**r) for r in json.loads(self.options["ranges"])]
        return [Range(path, 0, 0) for path in files(self.options["path"])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        source = Bytes(part.path)
        if self.sums_only:
            made = {"sums": sums(source.read(part.start, part.end), source.escaped(part.start)), "level": _level(source)} if not part.level else edges(source, part, self.key)
            yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([part.start], pa.int64()), pa.array([json.dumps(made)])], names=["path", "start", "sums"])
        elif part.end:
            yield from _batches(records_of(source, part, self.key), part.number, part.path)
        else:
            yield from _batches(_whole(part.path, self.key, self.size), 0, part.path)


def files(path: str) -> list[str]:
    """The files at ``path``, itself or in it, in order."""
    system, name = _open(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(name, recursive=True))
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class _Stream(DataSourceStreamReader):
    """New files by modification time and name; the offset is the last of them."""

    def __init__(self, options: dict) -> None:
        self.reader = _Reader(options, False)
        self.path = options["path"]

    def _listed(self) -> list[tuple[int, str]]:
        system, _ = _open(self.path)
        return sorted((system.get_file_info(_open(f)[1]).mtime_ns, f) for f in files(self.path))

    def initialOffset(self) -> dict:
        return {"at": 0, "file": ""}

    def latestOffset(self) -> dict:
        listed = self._listed()
        return {"at": listed[-1][0], "file": listed[-1][1]} if listed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        first, last = (start["at"], start["file"]), (end["at"], end["file"])
        return [Range(f, 0, 0) for at, f in self._listed() if first < (at, f) <= last]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return self.reader.read(part)


class JsonListSource(DataSource):
    """``spark.read.format("json_list")``: ``record_no`` (in its file), ``value`` (the record's text) and ``file``."""

    @classmethod
    def name(cls) -> str:
        return "json_list"

    def schema(self) -> str:
        return "record_no long, value string, file string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), False)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


class JsonListSums(DataSource):
    """The first passes over the ranges of files: ``path``, ``start`` and ``sums`` as JSON."""

    @classmethod
    def name(cls) -> str:
        return "json_list_sums"

    def schema(self) -> str:
        return "path string, start long, sums string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), True)


def _asked(spark: SparkSession, ranges: list[Range], key: str) -> dict[tuple[str, int], dict]:
    """The sums of these ranges; a few numbers each."""
    if not ranges:
        return {}
    rows = spark.read.format("json_list_sums").options(ranges=json.dumps([vars(r) for r in ranges]), key=key).load().collect()
    return {(r.path, r.start): json.loads(r.sums) for r in rows}


def plan_ranges(spark: SparkSession, paths: list[str], key: str, size: int) -> list[Range]:
    """The ranges of all files with the state that each begins in."""
    ranges = [Range(p, start, min(start + size, n)) for p in paths for n in [Bytes(p).size] for start in range(0, max(n, 1), size)]
    told = _asked(spark, ranges, key)
    for before, part in zip([None, *ranges], ranges):
        own = told[part.path, part.start]
        part.level = own["level"]
        if before is not None and before.path == part.path:
            last = told[before.path, before.start]["sums"]
            part.in_string = before.in_string ^ bool(last["quotes"])
            part.depth = before.depth + last["starts"][before.in_string]["moved"]
    touching = [r for r in ranges if r.depth + told[r.path, r.start]["sums"]["starts"][r.in_string]["low"] < r.level]
    turned = _asked(spark, touching, key)
    number, inside, lists = 0, False, {p: 0 for p in paths}
    for part in ranges:
        inside = inside and part.start > 0
        part.number, part.inside = number, inside
        if (part.path, part.start) in turned:
            n, opened, inside = turned[part.path, part.start][str(int(inside))]
            lists[part.path] += opened
        else:
            n = told[part.path, part.start]["sums"]["starts"][part.in_string]["objects"].get(str(part.level - part.depth), 0) if inside else 0
        number += n
    if not all(lists.values()):
        _fail()
    return ranges


def read_json_list(spark: SparkSession, path: str, key: str = "jobs", size: int = RANGE) -> DataFrame:
    """``record_no`` (1-based, over all files in the order of their names), ``value`` and ``file`` of every object in the list."""
    for source in (JsonListSource, JsonListSums):
        spark.dataSource.register(source)
    ranges = plan_ranges(spark, files(path), key, size)
    if not ranges:
        return spark.createDataFrame([], JsonListSource({}).schema())
    return spark.read.format("json_list").options(ranges=json.dumps([vars(r) for r in ranges]), key=key).load()
