"""House CSV files as a Spark data source (``spark.read.format("house_csv")``).

A partition is a file, or a byte range of a large one. Its task reads the
file's own header, so files may differ in their columns and their order, and
nothing is read twice. All files give one schema: ``house_id``, ``Time``, the
readings, ``Issues``, further columns that the ``extra`` option names (as DOUBLE), and
``bad_values``: the text of what could not be read as its column's type
(``Aggregate=abc; Issues=x``). A line whose number of fields differs from the
header's stops the scan with an error, or, with ``bad_lines`` = ``keep``, becomes a row of nulls with
``line: <its text>`` there. A file without a ``Time`` or ``Unix`` column raises an error that
names it.

Paths are folders (searched with their sub-folders for ``*.csv``), files, or
URIs of any file system that Arrow opens. Values hold no line breaks.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as pa_csv
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20      # a larger file is read by several tasks
BLOCK_BYTES = 4 << 20       # what a task holds of a file at once
MISSING = ["", "NaN", "nan", "NA", "N/A", "null", "NULL"]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
PLAIN_TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
APPLIANCES = [f"Appliance{i}" for i in range(1, 10)]


def house_file_schema(extra: list[str] = ()) -> T.StructType:
    doubles = ["Aggregate", *APPLIANCES, *extra]
    return T.StructType([T.StructField("house_id", T.LongType()), T.StructField("Time", T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in doubles[:10]),
                         T.StructField("Issues", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in doubles[10:]), T.StructField("bad_values", T.StringType())])


def house_of(path: str) -> int | None:
    """The house that a file is of: the number after ``House`` in its name,
    else of its folder ``house_id=<n>``, else the last number in its name."""
    folder, _, name = path.rpartition("/")
    for text, pattern in ((name, r"(?i)house_?(\d+)"), (folder, r"house_id=(\d+)$"), (name, r"(\d+)\D*$")):
        found = re.search(pattern, text) if not (text is name and pattern.startswith(r"(\d") and name.startswith("part-")) else None
        if found:
            return int(found[1])
    return None


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def csv_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files, by path."""
    system, root = open_path(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{path}: no such folder or file")
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = re.compile(r"(^|/)[._][^/]*$")
    return sorted((f.path, f.size) for f in found if f.is_file and (info.is_file or (f.path.endswith(".csv") and not hidden.search(f.path[len(root):]))))


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def read_header(file: pa.NativeFile, path: str) -> tuple[list[str], int]:
    """Column names and the bytes of the first line."""
    first = b""
    while b"\n" not in first and (more := file.read(1 << 16)):
        first += more
    line, mark, _ = first.partition(b"\n")
    names = [c.strip() for c in next(csv.reader([line.decode("utf-8-sig").strip("\r")]), [])]
    if "Time" not in names and "Unix" not in names:
        raise ValueError(f"{path}: its header has neither a 'Time' nor a 'Unix' column")
    if len(set(names)) < len(names):
        raise ValueError(f"{path}: its header names a column twice")
    return names, len(line) + len(mark)


def line_blocks(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """Whole lines that begin in [start, end), in blocks."""
    file.seek(start)
    at, rest = start, b""
    while at < end or rest:
        block = file.read(BLOCK_BYTES)
        data = rest + block
        if not data:
            return
        if at + len(data) >= end:                           # the line that holds the last byte ends here
            stop = data.find(b"\n", max(0, end - 1 - at))
            if stop >= 0 or not block:
                yield data[:stop + 1] if stop >= 0 else data
                return
        cut = data.rfind(b"\n") + 1 if block else len(data)
        if cut:
            yield data[:cut]
        at, rest = at + cut, data[cut:]


def to_number(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values, and where a text is neither a number nor missing."""
    good = pc.match_substring_regex(text, NUMBER)
    bad = pc.and_not(pc.invert(good), pc.is_in(text, pa.array(MISSING)))
    return pc.if_else(good, text, None).cast(pa.float64()), bad.to_numpy(zero_copy_only=False)


def to_whole(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    value, bad = to_number(text)
    whole = pc.and_(pc.equal(pc.trunc(value), value), pc.less_equal(pc.abs(value), 2**31 - 1))
    bad |= pc.fill_null(pc.invert(whole), False).to_numpy(zero_copy_only=False)
    return pc.if_else(pc.fill_null(whole, False), value, None).cast(pa.int32()), bad


def _iso(text: str) -> datetime | None:
    try:
        t = datetime.fromisoformat(text)
    except ValueError:
        return None
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def to_time(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """ISO 8601; a time with an offset as its UTC time."""
    missing = pc.is_in(text, pa.array(MISSING))
    try:
        if pc.all(pc.or_(missing, pc.match_substring_regex(text, PLAIN_TIME))).as_py() in (True, None):
            return pc.if_else(missing, None, text).cast(pa.timestamp("us")), np.zeros(len(text), bool)
    except pa.ArrowInvalid:                                 # the 31st of February
        pass
    values = [None if t in MISSING else _iso(t) for t in text.to_pylist()]
    bad = [v is None and t not in MISSING for v, t in zip(values, text.to_pylist())]
    return pa.array(values, pa.timestamp("us")), np.array(bad, bool)


def from_epoch(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    value, bad = to_number(text)
    near = pc.less(pc.abs(value), 1e11)
    bad |= pc.fill_null(pc.invert(near), False).to_numpy(zero_copy_only=False)
    return pc.round(pc.multiply(pc.if_else(near, value, None), 1e6)).cast(pa.int64()).cast(pa.timestamp("us")), bad


def parse_block(data: bytes, names: list[str], path: str, schema: T.StructType, bad_lines: str = "fail") -> pa.RecordBatch:
    odd: list[str] = []

    def keep(row):
        odd.append(f"line: {row.text}")
        return "skip"
    table = pa_csv.read_csv(pa.py_buffer(data), read_options=pa_csv.ReadOptions(column_names=names, use_threads=False, block_size=max(len(data), 1) + 1),
                            parse_options=pa_csv.ParseOptions(invalid_row_handler=keep), convert_options=pa_csv.ConvertOptions(
                                column_types={n: pa.string() for n in names}, strings_can_be_null=False)).combine_chunks()
    if odd and bad_lines != "keep":
        raise ValueError(f"{path}: {len(odd)} lines whose number of fields is not the header's, the first {odd[0][:200]!r}")
    n = table.num_rows
    texts = {c: pc.utf8_trim_whitespace(table[c].combine_chunks() if n else pa.array([], pa.string())) for c in names}
    columns, bad = {"house_id": pa.array([house_of(path)] * (n + len(odd)), pa.int64())}, {}
    clock = "Time" if "Time" in names else "Unix"
    for f in schema.fields[1:-1]:
        source = clock if f.name == "Time" else f.name
        kind = pa.timestamp("us") if f.name == "Time" else pa.int32() if f.name == "Issues" else pa.float64()
        values = pa.nulls(n, kind)
        if source in names:
            read = {"Time": to_time, "Unix": from_epoch, "Issues": to_whole}.get(source, to_number)
            values, bad[source] = read(texts[source])
        columns[f.name] = pa.concat_arrays([values, pa.nulls(len(odd), kind)])
    notes: list[str | None] = [None] * n
    for i in np.flatnonzero(np.any(list(bad.values()), axis=0)) if n else ():
        notes[i] = "; ".join(f"{c}={texts[c][i].as_py()}" for c in bad if bad[c][i])
    columns["bad_values"] = pa.array(notes + odd, pa.string())
    return pa.RecordBatch.from_pydict(columns)


class HouseReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.out = options["path"], schema
        self.house = int(options["house"]) if options.get("house") else None
        self.bad_lines = options.get("bad_lines", "fail")
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        """No file of another house is opened where one is asked for."""
        files = [(p, n) for p, n in csv_files(self.path) if self.house is None or house_of(p) == self.house]
        return [Split(p, start, min(n, start + self.split_bytes)) for p, n in files for start in range(0, max(n, 1), self.split_bytes)] or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        system, _ = open_path(self.path)
        with system.open_input_file(split.path) as file:
            names, begin = read_header(file, split.path)
            start = begin
            if split.start:                                 # the line that begins before this range is another's
                file.seek(split.start - 1)
                while (more := file.read(1 << 16)) and b"\n" not in more:
                    pass
                start = max(begin, file.tell() - len(more) + more.find(b"\n") + 1) if more else split.end
            for data in line_blocks(file, start, split.end) if start < split.end else ():
                yield parse_block(data, names, split.path, self.out, self.bad_lines)


class HouseFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "house_csv"

    def schema(self) -> T.StructType:
        return house_file_schema([c.strip() for c in self.options.get("extra", "").split(",") if c.strip()])

    def reader(self, schema: T.StructType) -> HouseReader:
        return HouseReader(self.options, schema)
