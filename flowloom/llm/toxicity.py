"""Toxicity by a bag of subword embeddings and a linear softmax, trained jointly in numpy.

Features of a text are its words and the 3- to 6-grams of bytes inside each word framed by spaces, hashed to
2**17 rows of an embedding table. A text's vector is the mean of its features' rows; a softmax over two
classes reads it. Rows and softmax are trained together by gradient descent with per-parameter scaling, on
a sample of at most ``PER_CLASS`` labelled texts a class, the ones whose ids have the smallest hashes. Unseen
misspellings share most byte n-grams with the words they come from.

A long text can be harmless but for a passage, so texts are read in half-overlapping windows of ``WINDOW``
words; a text's score is its highest window's. Training starts from whole texts; in later rounds each text
is represented by its highest window so far, toxic and harmless ones alike. A word that came among the four
words before it is skipped, and means are taken over ``LEAST`` features at least, so that neither repeated
words nor very short texts make one word's chance weight count.

Scoring reads one number per feature, the difference of the two classes' logits, so it is one pass of table
look-ups. The model, 2**17 numbers, is what tasks receive.

Edge cases: null and empty texts, and texts without any learned feature, score by the fixed bias, 0.12. Labels
null or other than 0 and 1 teach nothing; repeated labels and documents teach once, and each document row
comes back. Without labels of both classes all scores are 0. Columns other
than id and text are never read for a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import bytewords
from flowloom.llm.common import arrow_map, fold_of, text_of

TABLE_LOG2 = 17
DIMENSIONS = 8
SIZES = (3, 4, 5, 6)
PER_CLASS = 1500
WINDOW = 24
LEAST = 200
FIRST_EPOCHS = 3
ROUNDS = 40
RATE = 0.3
#: Logit of a text without features that were learned: harmless.
BIAS = -2.0
#: How much a missed toxic text costs against a wrongly marked harmless one.
TOXIC_COST = 4.0

_FRAME = np.arange(256, dtype=np.uint8)
_FRAME[bytewords.PLAIN_BREAKS] = 32
_FRAME[65:91] += 32


@dataclass(frozen=True)
class Toxicity:
    """weights: logit difference per feature; bias: that of an empty text."""

    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of consecutive texts, the number of each feature's word, and the words before each text."""
    n = len(offsets) - 1
    wide = np.full(len(data) + 2 * n + 8, 32, np.uint8)
    at = np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(n), np.diff(offsets))
    wide[at] = _FRAME[data]
    space = wide == 32
    begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    word = np.zeros(len(wide), np.int32)
    word[begins] = 1
    np.cumsum(word, out=word)
    starts = np.searchsorted(begins, offsets + 2 * np.arange(n + 1))
    code = np.zeros(len(wide), np.uint64)
    found, owners = [], []
    end = len(wide) - 8
    # a gram may begin at the space before a word and may end at the one after it, not reach past them
    inner = np.cumsum(space, dtype=np.int32)
    for size in range(1, max(SIZES) + 1):
        code[:end] = code[:end] * np.uint64(257) + wide[size - 1:size - 1 + end]
        if size not in SIZES:
            continue
        stop = inner[size - 2:size - 2 + end] - inner[:end]  # spaces among the inner bytes
        good = np.flatnonzero((stop == 0) & ~(space[:end] & space[1:end + 1]) & ~((size == 3) & space[:end] & space[2:2 + end]))
        found.append(_slot(code[good], size))
        owners.append(word[good + 1] - 1)
    finish = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = bytewords._powers(len(wide))
    total = np.zeros(len(wide) + 1, np.uint64)
    np.cumsum(bytewords._WEIGHT[wide] * up, out=total[1:], dtype=np.uint64)
    whole = (total[finish] - total[begins]) * down[begins]
    found.append(_slot(whole, 0))
    owners.append(np.arange(len(begins), dtype=np.int32))
    feature, owner = np.concatenate(found), np.concatenate(owners)
    again = np.zeros(len(whole), bool)
    for back in range(1, 5):
        again[back:] |= whole[back:] == whole[:-back]
    again[starts[:-1][starts[:-1] < len(whole)]] = False
    kept = ~again[owner]
    return feature[kept], owner[kept], starts


def _slot(code: np.ndarray, size: int) -> np.ndarray:
    return (bytewords.mix(code + np.uint64(size * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - TABLE_LOG2)).astype(np.int32)


def _windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and text of all windows; half-overlapping, the whole text where it is short."""
    counts = np.diff(starts)
    half = WINDOW // 2
    held = np.maximum(1, -(-(counts - half) // half))
    text = np.repeat(np.arange(len(counts)), held)
    number = np.arange(len(text)) - np.repeat(np.cumsum(held) - held, held)
    first = starts[:-1][text] + number * half
    return first, np.minimum(first + WINDOW, starts[1:][text]), text


def _window_logits(feature, word, starts, model: Toxicity):
    sums = np.bincount(word, weights=model.weights[feature], minlength=int(starts[-1]))
    counts = np.bincount(word, minlength=int(starts[-1]))
    first, end, text = _windows(starts)
    total, many = np.concatenate([[0.0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    return model.bias + (total[end] - total[first]) / np.maximum(many[end] - many[first], LEAST), text, first, end


def highest(data: np.ndarray, offsets: np.ndarray, model: Toxicity) -> np.ndarray:
    """Logit difference of each text's highest window."""
    logit, text, _, _ = _window_logits(*features(data, offsets), model)
    best = np.full(len(offsets) - 1, -np.inf)
    np.maximum.at(best, text, logit)
    return best


class _Sample:
    """The features of all sampled texts in the order of their words, held in chunks of texts."""

    def __init__(self, texts: list[bytes]):
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.chunks = []
        for a, b in bytewords.chunks(offsets):
            found, word, starts = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            begin = np.zeros(int(starts[-1]) + 1, np.int64)
            np.cumsum(np.bincount(word, minlength=int(starts[-1])), out=begin[1:])
            self.chunks.append((found[np.argsort(word, kind="stable")], begin, starts))

    def bags(self, spans: list[tuple[np.ndarray, np.ndarray]]):
        """Distinct features of one span of words per text, their shares, and each text's bounds."""
        feats, shares, bounds = [], [], [0]
        for (feature, begin, _), (first, end) in zip(self.chunks, spans):
            for a, b in zip(begin[first], begin[end]):
                kind, many = np.unique(feature[a:b], return_counts=True)
                feats.append(kind)
                shares.append((many / max(LEAST, b - a)).astype(np.float32))
                bounds.append(bounds[-1] + len(kind))
        return np.concatenate(feats), np.concatenate(shares), np.array(bounds)

    def whole(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(starts[:-1], starts[1:]) for _, _, starts in self.chunks]

    def best(self, model: Toxicity) -> list[tuple[np.ndarray, np.ndarray]]:
        """The span of each text's highest window."""
        out = []
        for feature, begin, starts in self.chunks:
            value = np.concatenate([[0.0], np.cumsum(model.weights[feature], dtype=np.float64)])
            first, end, text = _windows(starts)
            a, b = begin[first], begin[end]
            logit = (value[b] - value[a]) / np.maximum(b - a, LEAST)
            order = np.lexsort((-logit, text))
            lead = order[np.flatnonzero(np.r_[True, np.diff(text[order]) > 0])]
            out.append((first[lead], end[lead]))
        return out


def _descend(state: dict, bags, labels: np.ndarray, epochs: int, rng: np.random.Generator, batch: int = 64) -> None:
    """Trains embedding rows and class vectors on the bags, in place."""
    feats, shares, bounds = bags
    table, scale, output, bias = state["table"], state["scale"], state["output"], state["bias"]
    balance = np.array([cost / max(1, (labels == c).sum()) for c, cost in ((0, 1.0), (1, TOXIC_COST))])
    balance *= len(labels) / balance[labels].sum()
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in part])
            lengths = bounds[part + 1] - bounds[part]
            owner = np.repeat(np.arange(len(part)), lengths)
            feature, share = feats[at], shares[at]
            rows = table[feature]
            mean = np.zeros((len(part), DIMENSIONS), np.float32)
            for d in range(DIMENSIONS):
                mean[:, d] = np.bincount(owner, weights=rows[:, d] * share, minlength=len(part))
            logits = mean @ output + bias
            logits -= logits.max(axis=1, keepdims=True)
            chance = np.exp(logits)
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(part)), labels[part]] -= 1.0
            error = chance * balance[labels[part]][:, None]
            back = (error @ output.T).astype(np.float32)
            slope = mean.T @ error / len(part)
            state["output_scale"] += slope**2
            output -= RATE * slope / np.sqrt(state["output_scale"])
            order = np.argsort(feature, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(feature[order]) > 0])
            step = np.add.reduceat((back[owner] * share[:, None])[order], first, axis=0)
            used = feature[order][first]
            scale[used] += (step**2).mean(axis=1)
            table[used] -= RATE * step / np.sqrt(scale[used])[:, None]


def _model(state: dict) -> Toxicity:
    axis = state["output"][:, 1] - state["output"][:, 0]
    return Toxicity((state["table"] @ axis).astype(np.float32), float(state["bias"][1] - state["bias"][0]))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 3) -> Toxicity:
    """The model from labelled texts; the same texts give the same model."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return Toxicity(np.zeros(1 << TABLE_LOG2, np.float32), -np.inf)
    rng = np.random.default_rng(seed)
    state = {
        "table": rng.normal(0, 0.1, (1 << TABLE_LOG2, DIMENSIONS)).astype(np.float32),
        "scale": np.full(1 << TABLE_LOG2, 1e-8, np.float32),
        "output": rng.normal(0, 1.0, (DIMENSIONS, 2)), "bias": np.array([-BIAS / 2, BIAS / 2]),
        "output_scale": np.full((DIMENSIONS, 2), 1.0),
    }
    sample = _Sample(texts)
    _descend(state, sample.bags(sample.whole()), labels, FIRST_EPOCHS, rng)
    for _ in range(ROUNDS):
        _descend(state, sample.bags(sample.best(_model(state))), labels, 1, rng)
    return _model(state)


def sample_labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[bytes], np.ndarray]:
    """At most ``per_class`` texts of each class, those with the smallest hashes of their ids.

    The ids are chosen without texts; the chosen ones, 2 * ``per_class`` at most, then pick the texts in one scan.
    """
    marked = labels.where("toxic in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).distinct()
    ids = docs.where(F.col("text").isNotNull()).select("doc_id").distinct()
    known = ids.join(marked, F.col("doc_id") == F.col("__id")).withColumn("rank", F.xxhash64("doc_id"))
    chosen = [r for toxic in (0, 1) for r in known.where(F.col("__toxic") == toxic).orderBy("rank", "doc_id").limit(per_class).select("doc_id", "__toxic").collect()]
    if not chosen:
        return [], np.zeros(0, np.int64)
    wanted = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "__id bigint, __toxic int"))
    held = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("__doc"), "text").join(wanted, F.col("__doc") == F.col("__id"))
    # of repeated documents one is enough
    found = held.groupBy("__id", "__toxic").agg(F.min(F.col("text").cast("binary")).alias("text")).orderBy("__id", "__toxic").toArrow()
    return found["text"].to_pylist(), found["__toxic"].to_numpy().astype(np.int64)


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """(doc_id, score): the highest window's probability of being toxic."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in batches:
            data, offsets = bytewords.text_buffers(batch.column(1))
            best = np.full(batch.num_rows, -np.inf)
            for a, b in bytewords.chunks(offsets):
                best[a:b] = highest(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], known)
            with np.errstate(over="ignore"):
                chance = 1.0 / (1.0 + np.exp(-best))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance)], ["doc_id", "score"])

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("text"))
    return arrow_map(picked, run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), trained on labels outside the held-out third of the ids."""
    held_out = fold_of("doc_id", 3) == 1
    model = train(*sample_labelled(docs.where(~held_out), labels))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score",
                                     (F.col("score") >= threshold).cast("int").alias("predicted"))
