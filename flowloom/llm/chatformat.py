"""Chat formatting by columnar byte assembly.

A conversation is marked turn by turn as ``<|im_start|>role\\n text <|im_end|>\\n``. Inside roles and texts the
two control strings, and the escape itself, are escaped: a backslash follows the ``<`` of every ``<|`` or of
every ``<`` with backslashes and ``|`` behind it, so no text can hold a control string and the way back takes
one backslash away. In roles backslashes are doubled as well and a line feed is written as backslash and n. The loss mask covers the escaped bytes of
assistant texts, not the markers.

Rows are sorted into ranges of conversations; a batch's headers, texts and footers are laid into one
preallocated buffer: lengths, cumulative offsets, then one scatter per kind of segment. The buffer is the
Arrow column's data as it is, with offsets where parts begin; only the part that is open at a batch's edge is
copied, to the front of the next buffer. A conversation of more than ``LARGE_TURNS`` rows may span ranges, so no
task has to hold it, and one of more than ``PART_BYTES`` is cut between turns: both come as several parts in
order, every other one as a single part.

Edge cases: rows of a conversation go by turn, then role and text; null turns come first. Null roles and
texts are empty; a null conv_id is a conversation of its own. Repeated rows are turns of their own. An empty
table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.bytewords import text_buffers
from flowloom.llm.common import arrow_map

OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>"
LARGE_TURNS = 1024
PART_BYTES = 4 << 20
FORMATTED = "conv_id bigint, range int, part int, n_turns bigint, formatted binary, loss_start array<bigint>, loss_end array<bigint>"

_ESCAPE = re.compile(rb"<(\\*)\|")
_UNESCAPE = re.compile(rb"<\\(\\*)\|")
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: bytes) -> bytes:
    return _ESCAPE.sub(rb"<\\\1|", text) if b"<" in text else text


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"<\1|", text) if b"<\\" in text else text


def escape_role(role: bytes) -> bytes:
    return escape(role).replace(b"\\", b"\\\\").replace(b"\n", b"\\n") if b"\\" in role or b"\n" in role or b"<|" in role else role


def unescape_role(role: bytes) -> bytes:
    if b"\\" not in role:
        return role
    return unescape(re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], role))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the segments, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def assemble(kinds: list[bytes], kind: np.ndarray, data: np.ndarray, offsets: np.ndarray,
             before: bytes | np.ndarray = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns behind the bytes ``before``, the turns' offsets in it, and where each text begins.

    ``kinds`` are the escaped roles and ``kind`` each turn's; ``data`` and ``offsets`` are the escaped texts.
    """
    n, base = len(kind), len(before)
    heads = [OPEN + role + b"\n" for role in kinds]
    sizes = np.array([len(h) for h in heads], np.int64)
    head_length = sizes[kind] if n else np.zeros(0, np.int64)
    foot = np.frombuffer(CLOSE + b"\n", np.uint8)
    text_length = np.diff(offsets)
    turns = np.full(n + 1, base, np.int64)
    turns[1:] += np.cumsum(head_length + text_length + len(foot))
    buffer = np.empty(int(turns[-1]), np.uint8)
    texts = turns[:-1] + head_length
    buffer[:base] = np.frombuffer(before, np.uint8) if isinstance(before, bytes) else before
    if n:
        named = np.frombuffer(b"".join(heads), np.uint8)
        buffer[_ranges(turns[:-1], head_length)] = named[_ranges((np.cumsum(sizes) - sizes)[kind], head_length)]
        buffer[_ranges(texts, text_length)] = data
        buffer[(turns[1:] - len(foot))[:, None] + np.arange(len(foot))] = foot
    return buffer, turns, texts


def _escaped(column) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and offsets with a backslash behind the ``<`` of every control string.

    All texts are searched at once; a match that reaches over the border of two texts is none.
    """
    data, offsets = text_buffers(column)
    found = np.array([m.span() for m in _ESCAPE.finditer(memoryview(np.ascontiguousarray(data)))], np.int64).reshape(-1, 2)
    inside = np.searchsorted(offsets, found[:, 0], "right") == np.searchsorted(offsets, found[:, 1] - 1, "right")
    at = found[inside, 0]
    if not len(at):
        return data, offsets
    return np.insert(data, at + 1, 92), offsets + np.searchsorted(at, offsets, "left")


def _part_borders(borders: np.ndarray, part_bytes: int) -> list[int]:
    """Where the parts of one conversation begin, from the byte positions between its turns (first and end included)."""
    starts, at = [], 0
    while at < len(borders) - 1:
        starts.append(int(borders[at]))
        at = max(at + 1, int(np.searchsorted(borders, borders[at] + part_bytes, "right")) - 1)
    return starts


def _columns(at: int, ids: list, parts: list[int], counts: np.ndarray, buffer: np.ndarray, starts: np.ndarray,
             low: np.ndarray, high: np.ndarray):
    """Record batches of the parts that begin at ``starts[:-1]``; the buffer itself is the binary column.

    ``low`` and ``high`` are the loss spans in the buffer. Offsets have 32 bits, so a batch spans at most 2^30 bytes
    or one part.
    """
    import pyarrow as pa

    first = 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + (1 << 30), "right")) - 1)
        last = min(last, len(ids))
        edges = starts[first:last + 1]
        offsets = (edges - edges[0]).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(offsets), pa.py_buffer(buffer[edges[0]:edges[-1]])])
        cuts = np.searchsorted(low, edges, "left")
        inside = slice(cuts[0], cuts[-1])
        origin = np.repeat(edges[:-1], np.diff(cuts))
        spans = [pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), pa.array(v[inside] - origin, pa.int64())) for v in (low, high)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[first:last], pa.int64()), pa.array(np.full(last - first, at, np.int32)), pa.array(parts[first:last], pa.int32()),
             pa.array(counts[first:last], pa.int64()), blobs, *spans],
            ["conv_id", "range", "part", "n_turns", "formatted", "loss_start", "loss_end"])
        first = last


def format_conversations(rows: DataFrame, large_turns: int = LARGE_TURNS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(conv_id, range, part, n_turns, formatted, loss_start, loss_end); parts of a conversation by range and part.

    Loss spans are byte positions in ``formatted``.
    """
    given = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    large = given.groupBy("conv_id").count().where(F.col("count") > large_turns).select(F.col("conv_id").alias("__large"))
    marked = given.join(large, F.col("conv_id").eqNullSafe(F.col("__large")), "left").withColumns({
        f"__{c}": F.when(F.col("__large").isNotNull(), e) for c, e in (("turn", F.col("turn")), ("role", F.col("role")), ("head", F.substring("text", 1, 64)))})
    order = ["conv_id", "turn", "role", "text"]
    dealt = marked.repartitionByRange("conv_id", "__turn", "__role", "__head")

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        none = np.zeros(0, np.int64)
        # the part that is open at a batch's edge: its bytes, turns and loss spans go before the next batch's
        held, conv, part, turns_held, low_held, high_held = b"", None, 0, 0, none, none

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            known, values = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            change = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (known[1:] != known[:-1])])
            named = batch.column(1).dictionary_encode()
            kinds = named.dictionary.to_pylist()
            kind = named.indices.to_numpy()
            data, offsets = _escaped(batch.column(2))
            buffer, turns, texts = assemble([escape_role(k.encode()) for k in kinds], kind, data, offsets, held)
            learned = np.flatnonzero(np.array([k == "assistant" for k in kinds])[kind])
            low = np.concatenate([low_held, texts[learned]])
            high = np.concatenate([high_held, (texts + np.diff(offsets))[learned]])
            part_ids, numbers, starts = [], [], []
            goes_on = False
            if turns_held:
                goes_on = conv == (int(values[0]) if known[0] else None)
                if not goes_on:
                    part_ids, numbers, starts = [conv], [part], [0]
            ends = np.append(change[1:], len(values))
            for i, (a, b) in enumerate(zip(change.tolist(), ends.tolist())):
                first = i == 0 and goes_on
                borders = turns[a:b + 1]
                if first:
                    borders = np.concatenate([[0], borders])
                begins = [int(borders[0])] if borders[-1] - borders[0] <= part_bytes else _part_borders(borders, part_bytes)
                starts += begins
                number = part if first else 0
                numbers += range(number, number + len(begins))
                part_ids += [int(values[a]) if known[a] else None] * len(begins)
            edges = np.append(np.array(starts, np.int64), len(buffer))
            counts = np.diff(np.searchsorted(turns[:-1], edges, "left"))
            counts[0] += turns_held
            yield from _columns(at, part_ids[:-1], numbers[:-1], counts[:-1], buffer, edges[:-1], low, high)
            opened = int(edges[-2])
            rest = np.searchsorted(low, opened, "left")
            held, conv, part, turns_held = buffer[opened:].copy(), part_ids[-1], numbers[-1], int(counts[-1])
            low_held, high_held = low[rest:] - opened, high[rest:] - opened
        if turns_held:
            yield from _columns(at, [conv], [part], np.array([turns_held]), held, np.array([0, len(held)]), low_held, high_held)

    return arrow_map(dealt.sortWithinPartitions(*order).select("conv_id", "role", "text"), run, FORMATTED)


def parse(formatted: bytes):
    """(role, text) of every turn of a formatted part."""
    for turn in _TURN.finditer(formatted):
        yield unescape_role(turn[1]), unescape(turn[2])


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted parts, one row per conversation; parts stream through the hashes."""
    import pyarrow as pa

    def run(batches):
        state = None

        def fresh(conv):
            return {"id": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}

        def closed(s):
            return (s["id"], s["turns"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"])

        def batch_of(out):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                              ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            out = []
            for conv, blob, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or state["id"] != conv:
                    if state is not None:
                        out.append(closed(state))
                    state = fresh(conv)
                state["chars"] += len(blob.decode())
                for role, text in parse(blob):
                    state["turns"] += 1
                    state["all"].update(role + b"\n" + text + b"\n")
                for a, b in zip(starts, ends):
                    text = unescape(blob[a:b])
                    state["loss"].update(text)
                    state["loss_chars"] += len(text.decode())
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of([closed(state)])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "range", "part")
    return arrow_map(ordered.select("conv_id", "formatted", "loss_start", "loss_end"), run,
                     "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
