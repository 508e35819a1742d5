"""Byte-level BPE in two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

Texts are split into pre-tokens with numpy over code-point classes, following the pattern of the rank files
(contractions, letters, numbers, other signs with one leading space, white space). Each pre-token has a 64-bit
hash from prefix sums. A minimal perfect hash over the vocabulary (bucket displacements, as many slots as
entries) gives the one entry that could be it; length and hash tell whether it is. What the vocabulary lacks is
merged once per distinct pre-token of a chunk: a heap holds the mergeable pairs of a linked list of byte
ranges, lowest rank and leftmost first. At the end each text's ids are put back into bytes and compared with
the text; where a hash deceived, the text is encoded again without hashes, so results are exact.

The tables that tasks use grow with the vocabulary alone. Texts are worked off in chunks of about a megabyte,
longer texts on their own.

Edge cases: a null text counts as empty and has no ids. Repeated ids are encoded row by row, null ids stay
null. Only the key and the text column are read, so other columns, whatever their names, do not matter. An
empty table gives an empty result. Strings of special tokens are ordinary text. ``decode`` of null is null; ids
outside the vocabulary raise an error.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.bytewords import _BASE, _powers, _WEIGHT, chunks, mix, text_buffers
from flowloom.llm.common import arrow_map, text_of

_U64 = np.uint64
#: Keys a bucket of the hash has on average, and merged pre-tokens a task remembers in each of two generations.
BUCKET = 4
REMEMBERED = 1 << 18

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file by id; ids have to run from 0 without gaps."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def code_point_classes() -> np.ndarray:
    """Class of every code point, as the library whose results are asked for has it.

    Unicode versions differ in what counts as a letter, so its own character classes are read out: a pattern of
    one class keeps that class's characters of a text of all code points.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        of_kind = tiktoken.Encoding(f"class-{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        kept = of_kind.decode(of_kind.encode_ordinary(every))
        out[np.frombuffer(kept.encode("utf-32-le"), np.uint32)] = kind
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First byte of every pre-token of consecutive texts."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    at_byte = np.zeros(n + 1, np.int64)
    np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=at_byte[1:])
    kind = classes[points]
    opens = np.zeros(n + 1, bool)  # where a text begins; one beyond the end
    opens[np.searchsorted(at_byte, offsets)] = True
    ends = opens[1:]
    turns = opens[:n].copy()
    turns[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank = (points == 0x20) & ~ends
    # a run of white space gives its last character away to a run that follows in the same text
    last_space = space & ~ends
    last_space[:-1] &= ~space[1:]
    last_space[-1:] = False
    first = turns.copy()
    first[last_space] = True
    # a single blank goes with what follows
    taken = np.zeros(n, bool)
    taken[1:] = last_space[:-1] & blank[:-1]
    first &= ~taken
    _contractions(points, kind, ends, turns & ~taken, first)
    return at_byte[:-1][first]


# fixed values: endings that follow an apostrophe as one pre-token
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def _contractions(points, kind, ends, starts, first) -> None:
    """An apostrophe that opens a pre-token takes one of the fixed endings with it; what follows begins anew."""
    n = len(points)
    for at in np.flatnonzero(starts & (points == 0x27) & ~ends):
        for ending in _ENDINGS:
            stop = at + 1 + len(ending)
            if stop <= n and not ends[at:stop - 1].any() and all(points[at + 1 + i] == ord(c) for i, c in enumerate(ending)):
                first[at + 1:stop] = False
                if stop < n and not ends[stop - 1]:
                    # letters going on begin a pre-token of their own; a blank's choice stands
                    if kind[stop] == LETTER:
                        first[stop] = True
                break


def hashes_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, _U64)
    np.cumsum(_WEIGHT[data] * up, out=total[1:], dtype=_U64)
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(_U64) * _BASE)


class PerfectHash:
    """A minimal perfect hash: every key has its own slot among as many slots as there are keys.

    Keys fall into buckets; buckets, largest first, look for a displacement that sends their keys to free
    slots. A look-up is one hash, one displacement and one slot.
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("keys of a perfect hash must differ")
        self.size, self.buckets = n, max(1, n // BUCKET)
        self.shift = np.zeros(self.buckets, _U64)
        self.slot_key = np.zeros(n, np.int64)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(counts)
        free = np.ones(n, bool)
        for b in np.argsort(-counts, kind="stable"):
            if not counts[b]:
                break
            own = order[ends[b] - counts[b]:ends[b]]
            shift, slots = self._free_place(keys[own], free)
            self.shift[b] = shift
            free[slots] = False
            self.slot_key[slots] = own

    def _free_place(self, keys: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray]:
        """The smallest displacement that sends a bucket's keys to different free slots; tried many at a time."""
        tried, many = 0, 16
        while True:
            shifts = np.arange(tried, tried + many, dtype=_U64)
            slots = self._slot(keys[None, :], shifts[:, None])
            fits = free[slots].all(axis=1)
            for i in np.flatnonzero(fits):
                if len(np.unique(slots[i])) == len(keys):
                    return int(shifts[i]), slots[i]
            tried, many = tried + many, min(many * 4, 1 << 16)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ _U64(0x5851F42D4C957F2D)) % _U64(self.buckets)).astype(np.int64)

    def _slot(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys + mix(shift * _BASE + _U64(1))) % _U64(self.size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of the only key that each of ``keys`` could be."""
        return self.slot_key[self._slot(keys, self.shift[self._bucket(keys)])]


@dataclass
class Vocabulary:
    """What tasks need to encode and decode; its size follows the vocabulary's."""
    tokens: list[bytes]
    data: np.ndarray = field(init=False, repr=False)
    begin: np.ndarray = field(init=False, repr=False)
    length: np.ndarray = field(init=False, repr=False)
    keys: np.ndarray = field(init=False, repr=False)
    table: PerfectHash = field(init=False, repr=False)
    classes: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        ends = np.cumsum(self.length)
        self.begin = ends - self.length
        self.keys = hashes_of(self.data, self.begin, ends)
        self.table = PerfectHash(self.keys)
        self.classes = code_point_classes()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("ranks", "recent", "older")}

    def ready(self) -> Vocabulary:
        """In a task: the ranks by bytes, and the merged pre-tokens met lately."""
        if "ranks" not in self.__dict__:
            self.ranks = {t: i for i, t in enumerate(self.tokens)}
            self.recent: dict[bytes, list[int]] = {}
            self.older: dict[bytes, list[int]] = {}
        return self

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that the vocabulary lacks: remembered, else merged."""
        if (found := self.recent.get(piece)) is None:
            if (found := self.older.get(piece)) is None:
                found = heap_merge(piece, self.ranks)
            if len(self.recent) >= REMEMBERED:
                self.recent, self.older = {}, self.recent
            self.recent[piece] = found
        return found


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge neighbours by lowest rank, leftmost first, over a linked list of byte ranges.

    A heap entry is a rank and the first byte of the left range; it counts only while ``pair`` says the same.
    """
    n, rank_of = len(piece), ranks.get
    after, before = list(range(1, n + 2)), list(range(-1, n))  # by a range's first byte: where its neighbours begin
    pair = [rank_of(piece[i:i + 2]) for i in range(n - 1)]  # rank of a range merged with the next one
    pair.append(None)
    heap = [rank << 32 | i for i, rank in enumerate(pair) if rank is not None]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFF
        if pair[i] != top >> 32:
            continue
        middle = after[i]
        stop = after[i] = after[middle]
        pair[middle] = pair[i] = None
        if stop < n:
            before[stop] = i
            if (rank := rank_of(piece[i:after[stop]])) is not None:
                pair[i] = rank
                heapq.heappush(heap, rank << 32 | i)
        if (j := before[i]) >= 0:
            pair[j] = rank = rank_of(piece[j:stop])
            if rank is not None:
                heapq.heappush(heap, rank << 32 | j)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at:after[at]]])
        at = after[at]
    return out


def _gather(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges' values one after the other."""
    total = int(length.sum())
    out_begin = np.cumsum(length) - length
    return values[np.arange(total) + np.repeat(begin - out_begin, length)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return sizes, np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))


def encode_chunk(data: np.ndarray, offsets: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of consecutive texts, and where each text's ids begin (n + 1 positions)."""
    begin = pre_tokens(data, offsets, words.classes)
    end = np.append(begin[1:], len(data))
    if not len(begin):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    keys = hashes_of(data, begin, end)
    found = words.table(keys)
    known = (words.keys[found] == keys) & (words.length[found] == end - begin)
    counts = np.ones(len(begin), np.int64)
    misses = np.flatnonzero(~known)
    if len(misses):
        _, example, kind = np.unique(keys[misses], return_index=True, return_inverse=True)
        at = misses[example]
        raw = data.tobytes()
        lists = [words.merged(raw[a:b]) for a, b in zip(begin[at].tolist(), end[at].tolist())]
        sizes, flat = _flat(lists)
        counts[misses] = sizes[kind]
    place = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), np.int64)
    ids[place[known]] = found[known]
    if len(misses):
        own = sizes[kind]
        ids[_gather(np.arange(len(ids)), place[misses], own)] = _gather(flat, (np.cumsum(sizes) - sizes)[kind], own)
    starts = np.append(place, len(ids))[np.searchsorted(begin, offsets)]
    # the proof: back to bytes, text by text
    if not np.array_equal(decode_ids(ids, words), data):
        ids, starts = _without_hashes(data, offsets, begin, end, words)
    return ids.astype(np.uint32), starts


def _without_hashes(data, offsets, begin, end, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    pieces = [data[a:b].tobytes() for a, b in zip(begin, end)]
    counts, ids = _flat([[words.ranks[p]] if p in words.ranks else words.merged(p) for p in pieces])
    return ids, np.append(0, np.cumsum(counts))[np.searchsorted(begin, offsets)]


def decode_ids(ids: np.ndarray, words: Vocabulary) -> np.ndarray:
    return _gather(words.data, words.begin[ids], words.length[ids])


def _binary(data: np.ndarray, offsets: np.ndarray, missing=None):
    """An Arrow binary array over the buffer as it is."""
    import pyarrow as pa

    valid = None if missing is None or not missing.any() else pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        valid, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def encode(documents: DataFrame, words: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``ids``): each text's ids as little-endian unsigned 32-bit integers."""
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import pyarrow as pa

        words = shared.value.ready()
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets):
                ids, starts = encode_chunk(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), _binary(ids.astype("<u4").view(np.uint8), starts * 4)], names=["key", "ids"])

    read = documents.select(F.col(key).alias("key"), text_of(text).alias("text"))
    kind = read.schema["key"].dataType.simpleString()
    return arrow_map(read, run, f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, words: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ``ids``, ``decoded``): the bytes that each row's ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import pyarrow as pa

        words = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            missing = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                own = np.frombuffer(data[offsets[a]:offsets[b]].tobytes(), "<u4").astype(np.int64)
                ends = np.append(0, np.cumsum(words.length[own]))[(offsets[a:b + 1] - offsets[a]) // 4]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     _binary(decode_ids(own, words), ends, missing[a:b])], names=["key", "ids", "decoded"])

    read = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = read.schema["key"].dataType.simpleString()
    return arrow_map(read, run, f"key {kind}, ids binary, decoded binary").withColumnsRenamed({"key": key, "ids": ids})
