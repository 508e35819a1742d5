"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of 24 words, encoded as word numbers of the benchmark's vocabulary. Document
frequencies count all passages. A randomised decomposition of the TF-IDF passages gives the latent space:
every task multiplies its passages into a random sketch (A^T A) G, the sketches are summed, and the right
singular vectors follow from the sum alone. The benchmark's own passages enter with the same total energy as
the corpus. The decomposition is fitted on all passages of the corpus and scaled by their energy; every
passage of every document is then projected. Windows of two passages are compared by cosine with the benchmark
segments of up to 24 words, windows of three with the longer ones, in blocks. A window is a candidate if its
cosine reaches a floor, or if its product with the segment reaches a share of the segment's own square, which
other words in the window do not dilute. Items that occur word by word, whatever their length, are found by
walking a tree of all items' words along each text, without the latent space. Another candidate stands if a stretch of text not much longer than
the item holds enough of the item's words in their order (longest common subsequence), enough of their
weight, and enough of the answer, which is the item's last words. So paraphrases are found that keep most
words, and common words alone do not count.

The benchmark is worked off in blocks of bounded size, each over the whole corpus. What reaches the driver
is one block's items, frequencies and sketch, all bounded by the block. Words are runs of letters, digits and
non-ASCII characters, A to Z lowered.

Edge cases: null or wordless texts and items match nothing; items of fewer than five words must occur word
by word. A document without an id is not searched. Repeated rows and items give one result per pair of ids,
the best. Empty tables give an empty result. Other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import bytewords
from flowloom.llm.common import arrow_map, text_of, with_row_key
from flowloom.session import stored

PASSAGE = 24
SEGMENT = 48
RANK = 96
EXTRA = 16
COSINE = 0.45
HELD = 0.5
SHARED_WORDS = 0.75
SHARED_WEIGHT = 0.7
ANSWER_SHARE = 0.5
STRETCH = 1.25
BLOCK_BYTES = 1 << 18
SLICE_WORDS = 1 << 18
FIT_PASSAGES = 512  # multiplied at a time while fitting; all passages are fitted on
RESULT = "doc_id bigint, item_id bigint, item_words int, matched_words int, similarity double"


@dataclass(frozen=True)
class Items:
    """One benchmark block: ids, word numbers per item, and the sorted hashes that number the words."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: np.ndarray


@dataclass(frozen=True)
class Latent:
    """idf: per word; basis: weighted (words + 1, rank), the last row zero for foreign words.

    segments: per window length in passages, the latent unit rows, their lengths before and the item of each.
    """

    idf: np.ndarray
    basis: np.ndarray
    segments: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def encode_items(ids: list[int], texts) -> Items:
    data, offsets = bytewords.text_buffers(texts)
    hashes, starts = bytewords.words(data, offsets, bytewords.PLAIN_BREAKS)
    vocabulary = np.unique(hashes)
    numbers = np.searchsorted(vocabulary, hashes)
    held = [(i, numbers[starts[k]:starts[k + 1]]) for k, i in enumerate(ids) if i is not None and starts[k] < starts[k + 1]]
    return Items([i for i, _ in held], [w for _, w in held], vocabulary)


def encode(docs: DataFrame, items: Items, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, words): the word numbers of each text as 32-bit integers, -1 for words of no item."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            data, offsets = bytewords.text_buffers(batch.column(1))
            out = []
            for a, b in bytewords.chunks(offsets):
                hashes, starts = bytewords.words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], bytewords.PLAIN_BREAKS)
                at = np.searchsorted(vocabulary, hashes)
                at[at == len(vocabulary)] = 0
                numbers = np.where(vocabulary[at] == hashes, at, -1).astype(np.int32)
                out += [numbers[starts[i]:starts[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "words"])

    picked = docs.where(F.col(f"`{id_column}`").isNotNull()).select(
        F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), text_of(text_column).alias("text"))
    return arrow_map(picked, run, "doc_id bigint, words binary")


def _passages(batch, foreign: int):
    """Rows of PASSAGE word numbers for runs of documents of a batch: (first document, last, matrix, passage counts)."""
    data, offsets = bytewords.text_buffers(batch.column(1))
    offsets = offsets // 4
    numbers = np.frombuffer(data.tobytes(), np.int32)
    for a, b in bytewords.chunks(offsets, SLICE_WORDS):
        lengths = np.diff(offsets[a:b + 1])
        held = -(-lengths // PASSAGE)
        begin = np.zeros(b - a, np.int64)
        np.cumsum(held[:-1] * PASSAGE, out=begin[1:])
        flat = np.full(int(held.sum()) * PASSAGE, foreign, np.int32)
        own = numbers[offsets[a]:offsets[b]]
        flat[np.arange(len(own)) - np.repeat(offsets[a:b] - offsets[a] - begin, lengths)] = np.where(own < 0, foreign, own)
        yield a, b, flat.reshape(-1, PASSAGE), held


def frequencies(encoded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many passages each word occurs, and the number of passages, over all documents."""
    import pyarrow as pa

    def run(batches):
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, _, matrix, _ in _passages(batch, size):
                row = np.sort(matrix, axis=1)
                new = np.ones(row.shape, bool)
                new[:, 1:] = row[:, 1:] != row[:, :-1]
                found = np.bincount(row[new], minlength=size + 1)
                found[size] = len(matrix)  # the place of foreign words counts the passages
                counts += found
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["word", "count"])

    summed = arrow_map(encoded, run, "word bigint, count bigint").groupBy("word").agg(F.sum("count").alias("count")).toArrow()
    counts = np.zeros(size + 1, np.int64)
    counts[summed["word"].to_numpy()] = summed["count"].to_numpy()
    return counts[:size], int(counts[size])


def _project(matrix: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over each passage's words; the table's last row is zero, for foreign words."""
    out = np.zeros((len(matrix), table.shape[1]), np.float32)
    for at in range(0, len(matrix), 1024):
        part = matrix[at:at + 1024]
        total = out[at:at + len(part)]
        for column in part.T:
            total += table[column]
    return out


def _energy(matrix: np.ndarray, idf: np.ndarray) -> float:
    """The sum of squares of these TF-IDF passages."""
    squares, total = np.append(idf.astype(np.float64) ** 2, 0.0), 0.0
    for at in range(0, len(matrix), 4096):
        row = np.sort(matrix[at:at + 4096], axis=1)
        new = np.ones(row.shape, bool)
        new[:, 1:] = row[:, 1:] != row[:, :-1]
        begin = np.flatnonzero(new)
        total += float((np.diff(np.append(begin, row.size)).astype(np.float64) ** 2 * squares[row.ravel()[begin]]).sum())
    return total


def _gram_sketch(matrix: np.ndarray, idf: np.ndarray, table: np.ndarray, into: np.ndarray) -> None:
    """Adds (A^T A) G of these passages to ``into``; ``table`` is G weighted by idf, with a zero row."""
    foreign = len(idf)
    for at in range(0, len(matrix), FIT_PASSAGES):
        part = matrix[at:at + FIT_PASSAGES]
        flat = part.ravel()
        own = np.flatnonzero(flat != foreign)
        own = own[np.argsort(flat[own], kind="stable")]
        if not len(own):
            continue
        word = flat[own]
        first = np.flatnonzero(np.r_[True, np.diff(word) > 0])
        back = np.add.reduceat(_project(part, table)[own // PASSAGE], first, axis=0)
        into[word[first]] += back * idf[word[first], None]


def sketch(encoded: DataFrame, idf: np.ndarray, random: np.ndarray) -> tuple[np.ndarray, float]:
    """The sum of all tasks' sketches over all passages, and the passages' energy.

    Tasks hand on slices of rows, and adding tasks hold one slice each; the energy is a slice of its own.
    """
    import pyarrow as pa

    size, width = random.shape
    slices = max(1, min(32, size // 128))
    borders = np.linspace(0, size, slices + 1).astype(int)
    shared = encoded.sparkSession.sparkContext.broadcast((idf, random))

    def partial(batches):
        idf, random = shared.value
        table = np.vstack([random * idf[:, None], np.zeros((1, width), np.float32)])
        total, energy = np.zeros((size, width), np.float64), 0.0
        for batch in batches:
            for _, _, matrix, _ in _passages(batch, size):
                _gram_sketch(matrix, idf, table, total)
                energy += _energy(matrix, idf)
        parts = [total[a:b] for a, b in zip(borders[:-1], borders[1:])] + [np.array([energy])]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices + 1, dtype=np.int32)),
                                          pa.array([x.astype(np.float32).tobytes() for x in parts], pa.binary())], ["slice", "rows"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(rows, np.float32).astype(np.float64)
                sums[at] = sums[at] + values if at in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                         ["slice", "rows"])

    schema = "slice int, rows binary"
    parts = arrow_map(arrow_map(encoded, partial, schema).repartition(slices, "slice"), add, schema)
    out, energy = np.zeros((size, width)), 0.0
    for row in parts.collect():
        values = np.frombuffer(row["rows"], np.float64)
        if row["slice"] == slices:
            energy = float(values[0])
        else:
            a, b = borders[row["slice"]], borders[row["slice"] + 1]
            out[a:b] = values.reshape(b - a, width)
    return out, energy


def latent_space(encoded: DataFrame, items: Items, seed: int = 5) -> Latent:
    size = len(items.vocabulary)
    held, passages = frequencies(encoded, size)
    idf = (np.log((2.0 + passages) / (1.0 + held)) ** 2).astype(np.float32)
    width = min(size, RANK + EXTRA)
    random = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    corpus, whole = sketch(encoded, idf, random)
    pieces, owner = [], []
    for k, words in enumerate(items.words):
        for piece in np.array_split(words, -(-len(words) // SEGMENT)):
            pieces.append(piece)
            owner.append(k)
    dense = np.zeros((len(pieces), size), np.float32)
    own = np.zeros((size, width))
    energy = 0.0
    for row, piece in zip(dense, pieces):
        np.add.at(row, piece, idf[piece])
        energy += float(row @ row)
        used = np.unique(piece)
        own[used] += np.outer(row[used], row[used] @ random[used])
    both = corpus / max(whole, 1e-12) + own / max(energy, 1e-12)
    # both = H G for a positive semi-definite H: its leading eigenvectors from the sketch alone
    shift = 1e-9 * np.linalg.norm(both) * np.sqrt(width)
    moved = both + shift * random
    inner = random.T.astype(np.float64) @ moved
    inner = (inner + inner.T) / 2
    values, vectors = np.linalg.eigh(inner)
    good = values > values[-1] * 1e-10
    left, _, _ = np.linalg.svd(moved @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    left = left[:, :RANK]
    rows = dense @ left.astype(np.float32)
    norms = np.maximum(np.linalg.norm(rows, axis=1), 1e-9)
    rows /= norms[:, None]
    basis = np.vstack([left * idf[:, None], np.zeros((1, left.shape[1]))]).astype(np.float32)
    short = np.array([len(piece) <= PASSAGE for piece in pieces])
    owner = np.array(owner)
    return Latent(idf, basis, {2: (rows[short], norms[short], owner[short]), 3: (rows[~short], norms[~short], owner[~short])})


def phrase_tree(items: Items) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per depth: the sorted keys (parent node, word) that number its nodes, the nodes that end items, and those items."""
    lengths = np.array([len(w) for w in items.words])
    node, levels = np.zeros(len(lengths), np.int64), []
    alive = np.arange(len(lengths))
    for depth in range(int(lengths.max(initial=0))):
        alive = alive[lengths[alive] > depth]
        word = np.array([items.words[k][depth] for k in alive], np.int64)
        keys, node[alive] = np.unique(node[alive] * (len(items.vocabulary) + 1) + word, return_inverse=True)
        ends = alive[lengths[alive] == depth + 1]
        ends = ends[np.argsort(node[ends], kind="stable")]
        levels.append((keys, node[ends], ends))
    return levels


def _verbatim(matrix: np.ndarray, document: np.ndarray, first: np.ndarray, tree, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Passage and item of the first place at which each document holds an item word by word."""
    flat = matrix.ravel()
    begins = np.zeros(size + 1, bool)
    begins[tree[0][0]] = True
    at = np.flatnonzero(begins[flat])
    end = first[document[at // PASSAGE] + 1] * PASSAGE
    node = np.zeros(len(at), np.int64)
    places, ended = [], []
    for depth, (keys, nodes, own) in enumerate(tree):
        inside = at + depth < end
        at, end, node = at[inside], end[inside], node[inside]
        if not len(at):
            break
        key = node * (size + 1) + flat[at + depth]
        node = np.searchsorted(keys, key)
        node[node == len(keys)] = 0
        good = keys[node] == key
        at, end, node = at[good], end[good], node[good]
        low = np.searchsorted(nodes, node)
        many = np.searchsorted(nodes, node, side="right") - low
        places.append(np.repeat(at, many))
        ended.append(own[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, item = np.concatenate(places), np.concatenate(ended)
    order = np.lexsort((place, item))
    place, item = place[order], item[order]
    owner = document[place // PASSAGE]
    new = np.ones(len(place), bool)
    new[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1])
    return place[new] // PASSAGE, item[new]


def common_subsequence(item: list[int], stretch: list[int]) -> int:
    """Length of the longest common subsequence, with the item's positions as bits of one number."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for w in stretch:
        hit = row & masks.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def confirm(item: np.ndarray, near: np.ndarray, idf: np.ndarray, present: np.ndarray) -> int:
    """Matched words if some stretch of ``near`` holds the item; 0 if none does. ``present`` is all-false scratch."""
    n = len(item)
    if n < 5:
        starts = np.flatnonzero(near[:max(0, len(near) - n + 1)] == item[0])
        return n if any(np.array_equal(near[s:s + n], item) for s in starts) else 0
    weights = idf[item]
    floor = SHARED_WEIGHT * float(weights.sum())

    def held(words: np.ndarray) -> bool:
        present[words] = True
        inside = present[item]
        inside &= item != len(idf)
        present[words] = False
        return float(weights[inside].sum()) >= floor and int(inside.sum()) >= SHARED_WORDS * n

    if not held(near):
        return 0
    words, answer = item.tolist(), item[-max(3, n // 5):].tolist()
    length, step, best = int(np.ceil(n * STRETCH)), max(1, n // 8), 0
    for s in range(0, max(1, len(near) - length + step), step):
        stretch = near[s:s + length]
        if not held(stretch):
            continue
        part = stretch.tolist()
        matched = common_subsequence(words, part)
        if matched > best and matched >= SHARED_WORDS * n and common_subsequence(answer, part) >= ANSWER_SHARE * len(answer):
            best = matched
    return best


def search(encoded: DataFrame, items: Items, latent: Latent, cosine: float = COSINE) -> DataFrame:
    """All (doc_id, item_id) pairs that are word by word the same, or of which a window is a candidate and its surroundings hold the item."""
    import pyarrow as pa

    size = len(items.vocabulary)
    shared = encoded.sparkSession.sparkContext.broadcast((items, latent, phrase_tree(items)))

    def run(batches):
        items, latent, tree = shared.value
        present = np.zeros(size + 1, bool)
        for batch in batches:
            found: dict[tuple[int, int], tuple[int, float]] = {}
            for a, b, matrix, held in _passages(batch, size):
                first = np.concatenate([[0], np.cumsum(held)])
                document = np.repeat(np.arange(b - a), held)
                vectors = _project(matrix, latent.basis)
                windows = vectors.copy()
                exact = _verbatim(matrix, document, first, tree, size)
                for ahead in range(1, 1 + max(latent.segments)):
                    if ahead in latent.segments:
                        _same(windows, *latent.segments[ahead], a, document, exact, items, found)
                        _candidates(windows, *latent.segments[ahead], cosine, ahead, a, matrix, first, document, items, latent.idf, present, found)
                    same = np.flatnonzero(document[ahead:] == document[:-ahead]) if len(matrix) > ahead else np.zeros(0, int)
                    windows[same] += vectors[same + ahead]
            keys = list(found)
            ids = batch.column(0).take(pa.array([d for d, _ in keys], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([items.ids[k] for _, k in keys], pa.int64()), pa.array([len(items.words[k]) for _, k in keys], pa.int32()),
                 pa.array([found[x][0] for x in keys], pa.int32()), pa.array([found[x][1] for x in keys], pa.float64())],
                ["doc_id", "item_id", "item_words", "matched_words", "similarity"])

    return arrow_map(encoded, run, RESULT)


def _same(windows, rows, norms, owner, offset, document, exact, items, found) -> None:
    """Puts the items held word by word into ``found``, with the highest cosine of the window at their first word."""
    for w, k in zip(*(x.tolist() for x in exact)):
        own = rows[owner == k]
        if len(own):
            near = float((own @ windows[w]).max() / max(np.linalg.norm(windows[w]), 1e-9))
            key = (offset + int(document[w]), k)
            found[key] = (len(items.words[k]), max(near, found[key][1]) if key in found else near)


def _candidates(windows, rows, norms, owner, cosine, length, offset, matrix, first, document, items, idf, present, found) -> None:
    """Puts the confirmed hits of these windows into ``found``: (document, item) to (matched words, cosine)."""
    flat = matrix.ravel()
    sizes = np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-9)
    for at in range(0, len(windows) if len(rows) else 0, 4096):
        near = windows[at:at + 4096] @ rows.T
        for w, s in zip(*(x.tolist() for x in np.nonzero(near >= np.minimum(cosine * sizes[at:at + 4096], HELD * norms)))):
            d, k = int(document[at + w]), int(owner[s])
            item, known = items.words[k], found.get((offset + d, k))
            if known and known[0] == len(item):
                continue
            begin, end = int(first[d]) * PASSAGE, int(first[d + 1]) * PASSAGE
            low = (at + w) * PASSAGE
            around = flat[max(begin, low - len(item)):min(end, low + length * PASSAGE + len(item))]
            matched = confirm(item, around, idf, present)
            if matched and (not known or matched > known[0]):
                found[(offset + d, k)] = (matched, float(near[w, s] / sizes[at + w, 0]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold benchmark items: doc_id, item_id, item_words, matched_words, similarity."""
    spark = docs.sparkSession
    picked = benchmark.select(F.col(f"`{item_column}`").cast("bigint").alias("item_id"), text_of(item_text).alias("text"))
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    found = None
    for block in range(blocks):
        part = picked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        items = encode_items(part["item_id"].to_pylist(), part["text"])
        if not items.ids:
            continue
        encoded = stored(encode(docs, items, id_column, text_column), "encoded")
        hits = search(encoded, items, latent_space(encoded, items))
        found = hits if found is None else found.union(hits)
    if found is None:
        return spark.createDataFrame([], RESULT)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("item_words").alias("item_words"), F.max("matched_words").alias("matched_words"), F.max("similarity").alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows whose text holds no benchmark item; columns as they are.

    Rows are told apart by id and text, so repeated and null ids are judged by their own texts.
    """
    keyed = with_row_key(docs, "__row", id_column, text_column)
    gone = leaks(keyed, benchmark, "__row", text_column).select(F.col("doc_id").alias("__row")).distinct()
    return keyed.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
