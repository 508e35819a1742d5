"""Near-duplicate documents by HyperMinHash.

A document is the set of its k-word shingles (``bytewords``). Its sketch has 128 registers: the top seven
bits of a shingle's hash choose the register, which keeps the least remainder as a count of leading zeros
(six bits) and the ten bits that follow. A register without shingles takes the value of an occupied one,
chosen by a fixed random order per register, so that small sets match with the probability of their Jaccard
similarity too.

Four registers form a band and equal bands make candidates: 32 bands miss a pair of similarity 0.8 with
probability (1 - 0.8^4)^32 < 5e-8. The estimate, corrected for accidental register matches, turns down
candidates more than five standard errors below the threshold; the others are compared on their whole sets.

No bucket is paired out. Texts with equal sets are one class. In each bucket every class is compared with
the bucket's smallest class; the links found give components. What is left are pairs of one bucket in
different components: those are compared in square blocks of bounded size, which tasks share. So every
candidate pair is either compared or inside one component already.

Edge cases: null texts and texts without words have no shingles, are linked with nothing and are kept. A
document with a null id has a class by its set as others have, is never the smallest id, and is compared
beyond equal sets only if another document of its set has an id. Repeated rows each come back. Columns other
than id and text do not matter.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm import bytewords
from flowloom.llm.common import arrow_map, text_of, with_row_key
from flowloom.session import stored

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
ZEROS_MAX = 63
BAND_ROWS = 4
BANDS = REGISTERS // BAND_ROWS
BLOCK = 2048
BLOCK_BYTES = 1 << 24

_U = np.uint64
_BORROW = bytewords.mix(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)).reshape(
    REGISTERS, REGISTERS)


def collision_rate(mantissa_bits: int = MANTISSA_BITS) -> float:
    """Chance that the registers of two disjoint sets of one size are equal.

    Both minima fall into the same interval [2^-z, 2^-z+1) * mantissa step; for minima that are nearly
    exponential the sum over all intervals is close to 1 / (6 ln 2 * 2^bits) and does not depend on the size.
    """
    return 1.0 / (6.0 * math.log(2.0) * (1 << mantissa_bits))


def corrected_jaccard(equal_share):
    """Similarity from the share of equal registers, without accidental matches."""
    c = collision_rate()
    return (equal_share - c) / (1.0 - c)


def estimate_floor(threshold: float) -> float:
    """Estimates below this are turned down: five standard errors under the threshold."""
    return threshold - 5.0 * math.sqrt(threshold * (1.0 - threshold) / REGISTERS)


def registers_of(codes: np.ndarray) -> np.ndarray:
    """The sketch of one non-empty set of sorted distinct hashes."""
    bucket = (codes >> _U(64 - BUCKET_BITS)).astype(np.intp)
    first = np.empty(len(codes), bool)
    first[0] = True
    np.not_equal(bucket[1:], bucket[:-1], out=first[1:])
    held = bucket[first]
    rest = codes[first] << _U(BUCKET_BITS)
    # leading zeros of the 64-bit remainder, exact: the float's exponent may round up, never down
    zeros = 63 - np.frexp(np.maximum(rest, _U(1)).astype(np.float64))[1].astype(np.int64) + 1
    zeros += (zeros < 64) & ((rest >> np.clip(63 - zeros, 0, 63).astype(np.uint64)) == 0)
    zeros = np.clip(zeros, 0, ZEROS_MAX)
    mantissa = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> _U(64 - MANTISSA_BITS)
    values = (zeros.astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)
    out = np.empty(REGISTERS, np.uint16)
    out[held] = values
    if len(held) < REGISTERS:
        empty = np.ones(REGISTERS, bool)
        empty[held] = False
        lone = np.flatnonzero(empty)
        out[lone] = values[_BORROW[np.ix_(lone, held)].argmin(axis=1)]
    return out


def digest_of(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def _sets(column, k: int):
    """The sets of an Arrow text column, one after another, in bounded chunks."""
    data, offsets = bytewords.text_buffers(column)
    for a, b in bytewords.chunks(offsets):
        hashes, starts = bytewords.words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        codes, at = bytewords.shingles(hashes, starts, k)
        for i in range(b - a):
            yield codes[at[i]:at[i + 1]]


def signatures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5) -> DataFrame:
    """Per document: id, number of shingles, digest of the set and registers (null for empty sets)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for codes in _sets(batch.column(1), k):
                sizes.append(len(codes))
                digests.append(digest_of(codes) if len(codes) else None)
                sketches.append(registers_of(codes).tobytes() if len(codes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "digest", "registers"])

    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_of(text_column).alias("text"))
    return arrow_map(picked, run, "doc_id bigint, n_shingles bigint, digest binary, registers binary")


def _set_table(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, k: int) -> DataFrame:
    """The whole sets of the classes in ``wanted`` (digest, doc_id of one member)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            digests, sets = [], []
            for codes, asked in zip(_sets(batch.column(1), k), batch.column(0).to_pylist()):
                if len(codes) and digest_of(codes) == asked:
                    digests.append(asked)
                    sets.append(codes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["digest", "codes"])

    texts = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_of(text_column).alias("text"))
    found = texts.join(wanted, "doc_id").select("digest", "text")
    return arrow_map(found, run, "digest binary, codes binary").dropDuplicates(["digest"])


def _linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether 100 * shared >= percent * united, on sorted distinct hashes."""
    small, large = (left, right) if len(left) <= len(right) else (right, left)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int(np.count_nonzero(large[at] == small))
    return 100 * shared >= percent * (len(left) + len(right) - shared)


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (digest, pivot) whose sizes and registers allow the threshold."""
    import pyarrow as pa

    floor = estimate_floor(percent / 100.0)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            left, right = (np.frombuffer(bytewords.text_buffers(batch.column(c))[0].tobytes(), np.uint16).reshape(n, REGISTERS)
                           for c in (2, 3))
            passed = pa.array(corrected_jaccard((left == right).mean(axis=1)) >= floor)
            yield batch.select([0, 1]).filter(passed)

    side = nodes.select("digest", "n_shingles", "registers")
    other = side.select(F.col("digest").alias("pivot"), F.col("n_shingles").alias("n_other"), F.col("registers").alias("theirs"))
    both = pairs.join(side, "digest").join(other, "pivot").where(
        F.least("n_shingles", "n_other") * 100 >= F.greatest("n_shingles", "n_other") * percent)
    return arrow_map(both.select("digest", "pivot", "registers", "theirs"), run, "digest binary, pivot binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            a, at = bytewords.text_buffers(batch.column(2))
            b, bt = bytewords.text_buffers(batch.column(3))
            ok = [_linked(np.frombuffer(a[at[i]:at[i + 1]].tobytes(), np.uint64), np.frombuffer(b[bt[i]:bt[i + 1]].tobytes(), np.uint64), percent)
                  for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    theirs = sets.select(F.col("digest").alias("pivot"), F.col("codes").alias("other_codes"))
    both = pairs.join(sets, "digest").join(theirs, "pivot").select("digest", "pivot", "codes", "other_codes")
    return arrow_map(both, run, "digest binary, pivot binary")


def components(links: DataFrame) -> DataFrame:
    """(digest, root) for every class with a link; root is the component's smallest digest.

    Labels spread to neighbours and are then replaced by their own labels, which halves the distance to
    the root in each round. Each round is a table in the shared folder.
    """
    edges = stored(links.select("digest", "pivot").union(links.select("pivot", "digest")).distinct(), "edges")
    labels = stored(edges.groupBy("digest").agg(F.least(F.min("pivot"), F.col("digest")).alias("root")), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("digest", "pivot"), "pivot").groupBy("digest").agg(F.min("root").alias("heard"))
        nearer = labels.join(heard, "digest", "left").select(
            "digest", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("digest").alias("root"), F.col("root").alias("next"))
        after = stored(nearer.join(jump, "root", "left").select(
            "digest", "old", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        labels = after.select("digest", "root")
        if after.where("old <> root").isEmpty():
            return labels


def _blocks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of buckets with several components, dealt to square blocks: one row per (bucket, i, j).

    A side of a block holds about ``BLOCK`` members or ``BLOCK_BYTES`` of sets, whichever is less.
    """
    counts = members.groupBy("key").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("codes"),
                                        F.min("root").alias("low"), F.max("root").alias("high"))
    sides = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("codes") * 8 / BLOCK_BYTES)).cast("int")
    mixed = counts.where("low <> high and size > 2").select("key", sides.alias("sides"))
    own = F.pmod(F.xxhash64("digest"), F.col("sides")).cast("int")
    known = members.join(mixed, "key").join(nodes.select("digest", "registers"), "digest")
    dealt = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                        "own", "digest", "pivot", "root", "n_shingles", "registers")


def _block_roots(t) -> np.ndarray:
    return np.unique(np.array(t["root"], dtype=object), return_inverse=True)[1]


def _block_pairs(t, root: np.ndarray, percent: int):
    """Index pairs of one block that may be links between components, each pair in its first common band only.

    The caller may join components in ``root`` on the way.
    """
    floor = estimate_floor(percent / 100.0)
    n = len(t["digest"])
    registers = np.frombuffer(b"".join(t["registers"]), np.uint16).reshape(n, REGISTERS)
    bands = registers.view(np.uint64)
    sizes, own = np.asarray(t["n_shingles"]), np.asarray(t["own"])
    i, j, band = t["i"][0], t["j"][0], t["band"][0]
    pivot = np.array([d == p for d, p in zip(t["digest"], t["pivot"])])
    for x in range(n):
        ys = np.arange(x + 1, n)
        ok = (root[ys] != root[x]) & ((own[ys] != own[x]) | (i == j))
        ok &= ~(pivot[ys] | pivot[x])  # those were compared at once
        ok &= 100 * np.minimum(sizes[ys], sizes[x]) >= percent * np.maximum(sizes[ys], sizes[x])
        ys = ys[ok]
        if not len(ys):
            continue
        ys = ys[corrected_jaccard((registers[ys] == registers[x]).mean(axis=1)) >= floor]
        if band and len(ys):
            ys = ys[~(bands[ys, :band] == bands[x, :band]).any(axis=1)]
        if len(ys):
            yield x, ys


def _rest(docs, members, nodes, done, id_column, text_column, k, percent) -> DataFrame:
    """Links between different components within one bucket."""
    import pyarrow as pa

    blocks = stored(_blocks(members, nodes).withColumn("band", F.pmod(F.col("key"), F.lit(BANDS)).cast("int")), "blocks")

    def flag(table):
        t = table.to_pydict()
        hit = np.zeros(len(t["digest"]), bool)
        for x, ys in _block_pairs(t, _block_roots(t), percent):
            hit[x] = True
            hit[ys] = True
        return table.filter(pa.array(hit)).select(["key", "i", "j", "digest"])

    asked = stored(blocks.groupBy("key", "i", "j").applyInArrow(flag, "key bigint, i int, j int, digest binary"), "asked")
    wanted = asked.select("digest").distinct().join(nodes.select("digest", "doc_id"), "digest")
    fresh = wanted.join(done.select("digest"), "digest", "left_anti")
    sets = done if fresh.isEmpty() else done.union(stored(_set_table(docs, fresh, id_column, text_column, k), "sets"))

    def compare(table):
        t = table.to_pydict()
        codes = [np.frombuffer(c, np.uint64) for c in t["codes"]]
        left, right = [], []
        root = _block_roots(t)
        for x, ys in _block_pairs(t, root, percent):
            for y in ys:
                # one link joins two components, the other pairs between them are answered then
                if root[x] != root[y] and _linked(codes[x], codes[y], percent):
                    root[root == root[y]] = root[x]
                    left.append(t["digest"][x])
                    right.append(t["digest"][y])
        return pa.table({"digest": pa.array(left, pa.binary()), "pivot": pa.array(right, pa.binary())})

    whole = blocks.join(asked, ["key", "i", "j", "digest"]).join(sets, "digest")
    return whole.groupBy("key", "i", "j").applyInArrow(compare, "digest binary, pivot binary")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked id, itself included), kept."""
    signed = stored(signatures(docs, id_column, text_column, k), "signatures")
    nodes = stored(signed.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "classes")
    bands = nodes.select("digest", "n_shingles", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring(
            F.col("registers"), b * (2 * BAND_ROWS) + 1, F.lit(2 * BAND_ROWS)))).alias("band", "part"))
    # the band is the key's remainder, so equal parts of different bands never meet
    keyed = bands.select("digest", "n_shingles", (F.shiftleft(F.shiftrightunsigned(F.xxhash64("part", "band"), 5), 5) + F.col("band")).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("digest").alias("pivot"), F.count("*").alias("size")).where("size > 1").drop("size")
    buckets = stored(keyed.join(shared, "key"), "buckets")
    star = _estimated(buckets.where("digest <> pivot").select("digest", "pivot").distinct(), nodes, percent)
    star = stored(star, "candidates")
    ends = star.select("digest").union(star.select("pivot")).distinct().join(nodes.select("digest", "doc_id"), "digest")
    sets = stored(_set_table(docs, ends, id_column, text_column, k), "sets")
    links = stored(_verified(star, sets, percent), "links")
    roots = components(links)
    members = buckets.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    more = stored(_rest(docs, members, nodes, sets, id_column, text_column, k, percent), "links")
    if not more.isEmpty():
        roots = components(links.union(more))
    rooted = nodes.select("digest", "doc_id").join(roots, "digest", "left").select(
        "digest", "doc_id", F.coalesce("root", "digest").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = rooted.join(least, "root").select("digest", "component_id")
    named = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id; columns as they are.

    Rows are told apart by id and text: different texts under one id are judged by their texts, rows with a
    null id go like others (they stay only where their group has no id), and of rows with equal id and text
    one stays. Rows without words are linked with nothing and all stay.
    """
    keyed = with_row_key(docs, "__row", id_column, text_column)
    found = near_duplicates(keyed, "__row", text_column, k, percent).where("n_shingles > 0")
    rows = stored(found.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group")).distinct(), "rows")
    ids = keyed.select("__row", F.col(f"`{id_column}`").alias("__id")).distinct()
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    first = rows.join(ids, "__row").groupBy("__group").agg(F.min(order)["row"].alias("__first"))
    gone = rows.join(first, "__group").where(F.col("__row") != F.col("__first")).select("__row")
    # equal rows share a key; a row without words is a group of its own
    own = F.when(~text_of(F.col(f"`{text_column}`")).rlike(r"[^ \t-\r]"), F.monotonically_increasing_id()).otherwise(-1)
    rest = keyed.withColumn("__own", own).join(gone, "__row", "left_anti")
    place = F.row_number().over(Window.partitionBy("__row", "__own").orderBy(F.lit(1)))
    return rest.withColumn("__place", place).where("__place = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
