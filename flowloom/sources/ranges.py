"""Capture files cut into byte ranges that decode independently and exactly.

A record's place in a capture follows from the one before it, so a range in the middle of a file first has
to find where a record begins: the first position from which a chain of plausible record headers leads on.
That is a guess, and it is checked. Each range reports where it begins and where its last record leads; a
range whose beginning is not where the range before it leads to is walked again from there. What comes out
equals reading each file from its first byte to its last, whatever its contents.

Ranges are rows of a DataFrame: Spark lists files and schedules ranges, tasks read their own bytes through
Arrow's file systems (local and mounted paths, and the remote stores it knows).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import ship, stored

# fixed values: leading bytes of capture files, both byte orders and both time resolutions
CLASSIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6),
    b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9),
}
BLOCK_FORMAT = b"\x0a\x0d\x0d\x0a"
MAGICS = [*CLASSIC, BLOCK_FORMAT]
_SECTION, _INTERFACE, _PACKET = 0x0A0D0D0A, 1, 6
# fixed values: kinds of blocks in use
_BLOCK_KINDS = [_SECTION, _INTERFACE, 2, 3, 4, 5, _PACKET, 7, 8, 9, 10, 0xBAD, 0x40000BAD]

RANGE_BYTES = 16 << 20  # a task holds one range and its records
CHAIN = 24  # plausible records in a row that make a beginning
LARGEST_RECORD = 1 << 18
AHEAD = 1 << 20  # bytes read beyond a range to follow a chain
_YEARS = 366 * 86400

#: Of a range: its bounds, where its first record begins (-1: none does), where its last one leads and how many packets it holds.
#: ``little`` is the byte order it was read in at its beginning; ``marks`` are the byte order and interfaces that begin in it, as (offset, order, tick); tick 0 is a section.
INDEX = "path string, length bigint, lo bigint, hi bigint, start bigint, stop bigint, records bigint, little boolean, marks array<struct<at: bigint, little: boolean, tick: double>>"


def byte_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, length, lo, hi) of every range of the files (``path``, ``length``); contents are not read."""
    meta = files.select("path", F.col("length").cast("bigint").alias("length")).where(F.col("length") > 0)
    lo = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint")))
    return meta.withColumn("lo", lo).withColumn("hi", F.least(F.col("lo") + range_bytes, F.col("length")))


class RangeFile:
    """Random access to one file."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)

    def read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at) if size > 0 else b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


@dataclass
class Layout:
    """What a file's first bytes say."""
    classic: bool
    order: str
    tick: float
    first: int
    second: int  # time of the first record, in seconds


def layout(file: RangeFile) -> Layout | None:
    """None for what is no capture."""
    head = file.read(0, 40)
    if head[:4] in CLASSIC:
        order, tick = CLASSIC[head[:4]]
        return Layout(True, order, tick, 24, struct.unpack_from(order + "I", head, 24)[0] if len(head) >= 28 else 0)
    if head[:4] == BLOCK_FORMAT and len(head) >= 12:
        return Layout(False, "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">", 1e-6, 0, 0)
    return None


def _words(data: np.ndarray, at: np.ndarray, order: str) -> np.ndarray:
    """The 32-bit word at each position."""
    b = [data[at + i].astype(np.int64) for i in range(4)]
    if order == ">":
        b.reverse()
    return b[0] | b[1] << 8 | b[2] << 16 | b[3] << 24


def _plausible(data: np.ndarray, at: np.ndarray, known: Layout, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a record could begin at each position, and its size; ``left`` bytes of the file are there."""
    if known.classic:
        sec, frac, kept, size = (_words(data, at + i, known.order) for i in (0, 4, 8, 12))
        fits = (kept <= LARGEST_RECORD) & (size <= 1 << 24) & (frac < round(1 / known.tick)) & (abs(sec - known.second) <= _YEARS)
        return fits & (kept + 16 <= left), kept + 16
    kind, size = _words(data, at, known.order), _words(data, at + 4, known.order)
    return np.isin(kind, _BLOCK_KINDS) & (size >= 12) & (size % 4 == 0) & (size <= 1 << 24) & (size <= left), size


def _chain_holds(data: np.ndarray, at: int, base: int, known: Layout, length: int) -> bool:
    for _ in range(CHAIN):
        if base + at == length:
            return True
        if at + 16 > len(data):
            return base + len(data) < length  # what was read ends here; a file that ends here breaks the chain
        fits, size = _plausible(data, np.array([at]), known, np.array([length - base - at]))
        if not fits[0]:
            return False
        end = at + int(size[0])
        if not known.classic and end <= len(data) and data[end - 4:end].tobytes() != data[at + 4:at + 8].tobytes():
            return False
        at = end
    return True


def _guess(data: np.ndarray, lo: int, hi: int, known: Layout, length: int) -> int:
    """First position of the range from which records seem to follow one another; -1 for none."""
    if lo <= known.first:
        return known.first if known.first < hi else -1
    last = min(hi - lo, len(data) - 16)
    for block in range(0, last, 1 << 16):
        at = np.arange(block, min(block + (1 << 16), last))
        fits, _ = _plausible(data, at, known, length - lo - at)
        for found in at[fits]:
            if _chain_holds(data, int(found), lo, known, length):
                return lo + int(found)
    return -1


def walk(data: bytes, base: int, start: int, hi: int, known: Layout, length: int, order: str | None = None):
    """Offsets of the records that begin in [start, hi), where the last one leads, and the marks among them.

    A record that is cut off or broken ends the file, as it does for a reader from the beginning.
    """
    at, found, marks = start - base, [], []
    order = order or known.order
    stop = hi - base
    if known.classic:
        read = struct.Struct(order + "I").unpack_from
        while at < stop:
            if base + at + 16 > length or base + at + 16 + read(data, at + 8)[0] > length:
                return found, length, marks
            found.append(base + at)
            at += 16 + read(data, at + 8)[0]
        return found, base + at, marks
    while at < stop:
        if base + at + 12 > length:
            return found, length, marks
        if data[at:at + 4] == BLOCK_FORMAT:
            order = "<" if data[at + 8:at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            marks.append((base + at, order == "<", 0.0))
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or base + at + size > length:
            return found, length, marks
        if kind == _INTERFACE:
            marks.append((base + at, order == "<", _resolution(data[at + 16:at + size - 4], order)))
        elif kind == _PACKET:
            found.append(base + at)
        at += size
    return found, base + at, marks


def _resolution(options: bytes, order: str) -> float:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1:
            raw = options[at + 4]
            return 2.0 ** -(raw & 0x7F) if raw & 0x80 else 10.0 ** -raw
        at += 4 + size + (-size % 4)
    return 1e-6


def _indexed(ranges: DataFrame) -> DataFrame:
    """Walk each range from ``start`` where the row has one, else from the first plausible record."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.DataType.fromDDL(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_index_row(row)], schema=schema)

    ship(ranges.sparkSession)
    return ranges.mapInArrow(run, INDEX)


def _index_row(row: dict) -> dict:
    path, length, lo, hi, start = row["path"], row["length"], row["lo"], row["hi"], row.get("start")
    out = {"path": path, "length": length, "lo": lo, "hi": hi, "start": -1, "stop": None, "records": 0, "little": None, "marks": []}
    with RangeFile(path) as file:
        known = layout(file)
        if known is None:
            return out
        data = file.read(lo, min(hi + AHEAD, length) - lo)
        if start is None:
            start = _guess(np.frombuffer(data, np.uint8), lo, hi, known, length)
        if start >= 0:
            order = None if row.get("little") is None else "<" if row["little"] else ">"
            records, stop, marks = walk(data, lo, start, hi, known, length, order)
            out.update(start=start, stop=stop, records=len(records), little=(order or known.order) == "<", marks=[{"at": a, "little": b, "tick": t} for a, b, t in marks])
    return out


def index(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ranges of all captures with their checked beginnings, one row a range.

    A wrong guess is repaired in further passes over the ranges concerned alone; each pass settles at
    least the first of them in every file.
    """
    found = stored(_indexed(byte_ranges(files, range_bytes)), "capture-index")
    before = Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        lead = F.last("stop", ignorenulls=True).over(before)
        # while the range that should lead here has none of its own, the next pass tells
        right = F.when(lead.isNull() | (lead < F.col("lo")), F.col("start")).when(lead < F.col("hi"), lead).otherwise(F.lit(-1))
        sections = F.last(F.try_element_at("marks", F.lit(-1))["little"], ignorenulls=True).over(before)
        checked = found.withColumns({"_right": right, "_little": sections})
        other_order = (F.col("start") >= 0) & F.col("_little").isNotNull() & (F.col("_little") != F.col("little"))
        wrong = checked.where((F.col("_right") != F.col("start")) | other_order)
        if wrong.isEmpty():
            return found
        # those before the first wrong one of a file are settled; all wrong ones are walked from where they should begin
        again = wrong.select("path", "length", "lo", "hi", F.col("_right").alias("start"), F.col("_little").alias("little"))
        fixed = _indexed(again.where("start >= 0")).unionByName(
            again.where("start < 0").select("path", "length", "lo", "hi", "start", F.lit(None).cast("bigint").alias("stop"),
                                            F.lit(0).cast("bigint").alias("records"), "little", F.array().cast("array<struct<at: bigint, little: boolean, tick: double>>").alias("marks")))
        found = stored(found.join(wrong.select("path", "lo"), ["path", "lo"], "left_anti").unionByName(fixed), "capture-index")


def with_marks(found: DataFrame) -> DataFrame:
    """Ranges that hold records, each with the number of its first packet in the file, ``first_seq``, and with
    the sections and interfaces of its file up to its end: a mark per section and interface, not per packet.
    """
    here = Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    return (found.withColumns({"marks": F.flatten(F.collect_list("marks").over(here)),
                               "first_seq": F.sum("records").over(here) - F.col("records")})
            .where((F.col("start") >= 0) & (F.col("stop") > F.col("start"))))
