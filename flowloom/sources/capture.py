"""Capture files as packet rows.

Files are cut into byte ranges (:mod:`flowloom.sources.ranges`) and each range is decoded by a task of its
own, many frames at a time (:mod:`flowloom.sources.frames`). Everything after decoding is DataFrame work.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions import net
from flowloom.schemas import PACKETS
from flowloom.session import ship
from flowloom.sources import frames as FR
from flowloom.sources import ranges as RG

#: Packets and the frames that yielded none, with the reason.
DECODED = PACKETS + ", skipped STRING"
FRAMES_PER_BATCH = 50_000


def read_files(spark: SparkSession, path: str, glob: str = "*.pcap*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def only_captures(files: DataFrame) -> DataFrame:
    """Files whose first four bytes are a capture magic; of a ``content`` column."""
    return files.where(F.hex(F.substring("content", 1, 4)).isin(*[m.hex().upper() for m in RG.MAGICS]))


def decode_files(files: DataFrame, range_bytes: int = RG.RANGE_BYTES) -> DataFrame:
    """One row per record of each capture among ``files`` (``path``, ``length``): a packet, or why it is none.

    ``seq`` is the record's number in its file. Files that are no captures give no rows; a record that is
    cut off or broken ends its file.
    """
    ship(files.sparkSession)
    found = RG.with_marks(RG.index(files, range_bytes))
    # a range is the unit of work: spread them over tasks whatever their number
    spread = found.select("path", "length", "start", "stop", "first_seq", "marks").repartition(
        max(1, min(found.count(), 4 * files.sparkSession.sparkContext.defaultParallelism)), "path", "start")
    return spread.mapInArrow(_range_decoder(), DECODED)


def decode_frames(table: DataFrame) -> DataFrame:
    """Frames that stand in a table (``file``, ``seq``, ``ts``, ``frame_len``, ``frame``) as decoded rows.

    A null frame counts as empty.
    """
    ship(table.sparkSession)
    names = table.select("file", F.col("seq").cast("bigint").alias("seq"), F.col("ts").cast("double").alias("ts"),
                         F.col("frame_len").cast("int").alias("frame_len"), F.coalesce("frame", F.lit(b"")).alias("frame"))
    return names.mapInArrow(_frame_decoder(), DECODED)


def packets(files: DataFrame, range_bytes: int = RG.RANGE_BYTES) -> DataFrame:
    """The decoded packets of capture files; :func:`skipped_packets` counts the others."""
    return decode_files(files, range_bytes).where(F.col("skipped").isNull()).drop("skipped")


def read_packets(spark: SparkSession, path: str, glob: str = "*.pcap*", range_bytes: int = RG.RANGE_BYTES) -> DataFrame:
    """Packets of all captures below ``path``."""
    return packets(read_files(spark, path, glob), range_bytes)


def write_captures(table: DataFrame, path: str) -> DataFrame:
    """Write a table of frames (``ts``, ``frame``) as classic captures below ``path``, one file a partition.

    A task that runs again writes the same file anew. Returns (path, length, records) of the files.
    """
    ship(table.sparkSession)
    table.sparkSession.range(1).write.mode("ignore").parquet(f"{path}/_made")  # the folder, made by Spark
    return table.select("ts", F.coalesce("frame", F.lit(b"")).alias("frame")).mapInArrow(
        _writer(path), "path STRING, length BIGINT, records BIGINT")


def skipped_packets(decoded: DataFrame) -> DataFrame:
    """Frames of each file that yielded no packet, by reason."""
    return decoded.where(F.col("skipped").isNotNull()).groupBy("file", F.col("skipped").alias("reason")).agg(
        F.count(F.lit(1)).alias("frames"))


def arp_events(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("arp_op").isNotNull()).select(
        "file", F.col("arp_op").alias("op"), "sender_mac", "sender_ip", "target_ip", "ts")


def ip_packets(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("src_ip").isNotNull())


def display_rows(decoded: DataFrame, info_chars: int = 120) -> DataFrame:
    """Packets as the eleven-column display row with flag names in the text, shown to ``info_chars``."""
    p = ip_packets(decoded)
    size = F.concat(F.lit("len="), F.col("payload_len").cast("string"))
    tcp = F.concat(F.lit("TCP ["), net.tcp_flag_text(F.col("tcp_flags")), F.lit("] "), size)
    web = F.when(F.col("dst_port") == 443, "HTTPS ").when(F.col("dst_port") == 80, "HTTP ").otherwise("")
    dns = (F.col("protocol") == "UDP") & ((F.col("dst_port") == 53) | (F.col("src_port") == 53))
    info = (F.when(F.col("protocol") == "TCP", F.concat(web, tcp)).when(dns, "DNS query/response")
            .when(F.col("protocol") == "UDP", F.concat(F.lit("UDP "), size))
            .when(F.col("protocol") == "ICMP", F.concat(F.lit("ICMP type="), F.col("icmp_type").cast("string")))
            .otherwise(F.concat(F.lit("IP proto="), F.col("protocol"))))
    shown = F.when(dns, "DNS").otherwise(F.col("protocol"))
    rows = p.withColumn("_info", info).withColumn("_shown", shown)
    return rows.select(
        "ts", "src_ip", "dst_ip", F.coalesce("src_port", F.lit(0)).alias("src_port"),
        F.coalesce("dst_port", F.lit(0)).alias("dst_port"), F.col("_shown").alias("protocol"),
        F.col("frame_len").alias("length"), F.left("_info", F.lit(info_chars)).alias("info"),
        net.packet_severity(F.col("dst_ip"), F.col("dst_port"), F.col("_shown"), F.col("_info")).alias("severity"),
        F.lit("packet").alias("event_type"), F.lit("capture").alias("source"))


def inventory(files: DataFrame, newest: int | None = None) -> DataFrame:
    """Capture files with size and time, newest first, all or ``newest`` of them; contents are not read."""
    meta = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    ordered = meta.orderBy(F.desc("modified"), F.asc("path"))
    return ordered if newest is None else ordered.limit(newest)


def inventory_stats(files: DataFrame) -> DataFrame:
    return files.select("path", "modificationTime").agg(
        F.count(F.lit(1)).alias("files"), F.max_by("path", F.struct("modificationTime", "path")).alias("latest"),
        F.max("modificationTime").alias("latest_time"))


def closed_chunks(files: DataFrame, processed: DataFrame, quiet_seconds: int = 15, now=None) -> DataFrame:
    """Files that are not empty, not processed (``path``) and no longer written to, oldest first."""
    clock = F.current_timestamp() if now is None else now
    ready = files.select("path", "length", "modificationTime").where(
        (F.col("length") > 0) & (F.col("modificationTime") <= clock - F.expr(f"interval {quiet_seconds} seconds")))
    return unprocessed(ready, processed, "path").orderBy("modificationTime", "path")


def unprocessed(rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the processed ones; rows without a key have not been processed."""
    return rows.join(processed.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


# ---- decoding inside a task ----------------------------------------------------------------

def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(path)
        name, records = f"part-{TaskContext.get().partitionId():05}.pcap", 0
        with system.open_output_stream(f"{base}/{name}") as out:
            out.write(struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, RG.LARGEST_RECORD, 1))
            for batch in batches:
                for ts, frame in zip(batch["ts"].to_pylist(), batch["frame"].to_pylist()):
                    us = round((ts or 0.0) * 1e6)
                    out.write(struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(frame), len(frame)) + frame)
                records += batch.num_rows
            length = out.tell()
        yield pa.RecordBatch.from_pylist([{"path": f"{path}/{name}", "length": length, "records": records}])

    return write


def _schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.DataType.fromDDL(DECODED))


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _frame_decoder():
    """The task function over tables of frames."""
    schema = _schema()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.column("frame")
            if not len(frame):
                continue
            offsets = np.frombuffer(frame.buffers()[1], np.int32)[frame.offset:frame.offset + len(frame) + 1].astype(np.int64)
            data = np.frombuffer(frame.buffers()[2] or b"", np.uint8)
            columns = FR.packet_columns(data, offsets[:-1], np.diff(offsets))
            yield _batch(columns | {c: batch.column(c) for c in ("file", "seq", "ts", "frame_len")}, schema)

    return decode


def _range_decoder():
    """The task function over ranges of capture files."""
    schema = _schema()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with RG.RangeFile(row["path"]) as file:
                    known = RG.layout(file)
                    data = file.read(row["start"], row["stop"] - row["start"])
                marks = [(m["at"], m["little"], m["tick"]) for m in row["marks"]]
                order = next(("<" if little else ">" for at, little, _ in reversed(marks) if at < row["start"]), None)
                found, _, _ = RG.walk(data, row["start"], row["start"], row["stop"], known, row["length"], order)
                read, at = np.frombuffer(data, np.uint8), np.array(found, np.int64)
                for a in range(0, len(at), FRAMES_PER_BATCH):
                    yield _records(row["path"], row["first_seq"] + a, read, row["start"], at[a:a + FRAMES_PER_BATCH], known, marks, schema)
                del data, read, found, at  # before the next range is read

    return decode


def _records(path: str, first_seq: int, data: np.ndarray, base: int, at: np.ndarray, known: RG.Layout, marks: list, schema: pa.Schema) -> pa.RecordBatch:
    """Records of one layout as decoded rows."""
    here = at - base
    if known.classic:
        sec, frac, kept, size = (RG._words(data, here + i, known.order) for i in (0, 4, 8, 12))
        ts, start = sec + frac * known.tick, here + 16
    else:
        ts, kept, size, start = _block_records(data, here, at, marks)
    shared = int(start.min())  # only these records' bytes go on
    stop = int((start + kept).max())
    columns = FR.packet_columns(data[shared:stop], start - shared, kept)
    return _batch(columns | {
        "file": pa.array([path] * len(at), pa.string()), "seq": pa.array(np.arange(len(at)) + first_seq, pa.int64()), "ts": pa.array(ts, pa.float64()),
        "frame_len": pa.array(size.astype(np.int32))}, schema)


def _block_records(data: np.ndarray, here: np.ndarray, at: np.ndarray, marks: list):
    """Times, sizes and places of packet blocks; byte order and resolution are those of their section's interface."""
    n = len(at)
    ts, kept, size = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    borders = [m[0] for m in marks] + [np.iinfo(np.int64).max]
    ticks: list[float] = []
    for (mark, little, tick), until in zip(marks, borders[1:]):
        ticks = [] if tick == 0 else [*ticks, tick]
        own = np.flatnonzero((at > mark) & (at < until))
        if not len(own):
            continue
        order, place = "<" if little else ">", here[own] + 8
        interface, high, low, kept[own], size[own] = (RG._words(data, place + i, order) for i in (0, 4, 8, 12, 16))
        known = np.array([*ticks, 1e-6])
        ts[own] = ((high << 32) | low) * known[np.minimum(interface, len(ticks))]
        room = RG._words(data, here[own] + 4, order) - 32  # of a block that claims more than it holds
        kept[own] = np.clip(kept[own], 0, np.maximum(room, 0))
    return ts, kept, size, here + 28


def request_fields(payload: bytes) -> dict:
    out = {}
    for line in payload.split(b"\r\n\r\n", 1)[0].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        key = {b"host": "http_host", b"user-agent": "user_agent"}.get(name.strip().lower())
        if key:
            out[key] = value.strip().decode("utf-8", "ignore")
    return out


def questions(payload: bytes) -> list[str]:
    if len(payload) < 12:
        return []
    names, at = [], 12
    for _ in range(struct.unpack_from("!H", payload, 4)[0]):
        labels = []
        while at < len(payload) and payload[at]:
            size = payload[at]
            if size & 0xC0:
                return names
            labels.append(payload[at + 1:at + 1 + size].decode("utf-8", "ignore"))
            at += 1 + size
        at += 5
        if at > len(payload):
            break
        if labels:
            names.append(".".join(labels))
    return names


class _Reader:
    """Length-prefixed fields of a handshake message."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, size: int) -> bytes:
        if self.at + size > len(self.data):
            raise ValueError("truncated")
        self.at += size
        return self.data[self.at - size:self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")

    def block(self, prefix: int) -> bytes:
        return self.take(self.number(prefix))


def _shorts(data: bytes) -> list[int]:
    return [int.from_bytes(data[i:i + 2], "big") for i in range(0, len(data) - 1, 2)]


def hello_fields(payload: bytes) -> dict:
    """Version, lists and server name of a client hello; what was read before a cut stays."""
    out: dict = {}
    try:
        r = _Reader(payload)
        r.take(5)
        if r.number(1) != 1:
            return out
        r.take(3)
        version = r.number(2)
        r.take(32)
        r.block(1)
        ciphers = _shorts(r.block(2))
        r.block(1)
        kinds: list[int] = []
        out.update(tls_version=version, tls_ciphers=ciphers, tls_extensions=kinds, tls_groups=[], tls_formats=[])
        ext = _Reader(r.block(2))
        while ext.at < len(ext.data):
            kind, body = ext.number(2), ext.block(2)
            kinds.append(kind)
            if kind == 0 and len(body) > 5:
                out["sni"] = body[5:5 + int.from_bytes(body[3:5], "big")].decode("utf-8", "ignore")
            elif kind == 10:
                out["tls_groups"] = _shorts(body[2:])
            elif kind == 11:
                out["tls_formats"] = list(body[1:])
    except ValueError:
        pass
    return out
