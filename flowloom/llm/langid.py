"""Language identification by bit-sliced Bloom filters over byte 4-grams.

Learning counts every 4-gram of the lowered texts per language, over all rows given. A gram belongs to a
language if its rate there is at least ``share`` of its highest rate in any language, so that foreign
quotations teach nothing. The filter has one row of language bits per position; a gram sets its languages'
bits in three rows. The AND of a gram's three rows names all languages that hold it. Per text, each
language's bits are counted and corrected for the false positives that the fill of its slice implies; the
highest corrected count decides, ties going to the language with more training text, then to the name.

What goes to the driver and back to the tasks is the filter: at most 2**22 rows, whatever was read.

Edge cases: null texts and texts without a letter are ``und`` with score 0. Texts too short for a gram, and
texts whose grams are all unknown, get the language with most training text and score 0. With nothing to
learn from, every text is ``und``. Rows with null id or null language can be predicted; null languages and
null texts teach nothing. Repeated rows count as often as they come and each come back. Other columns do
not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm import bytewords
from flowloom.llm.common import arrow_map, fold_of, text_of
from flowloom.session import stored

HASHES = 3
MIN_COUNT = 2
SHARE = 0.25
MAX_ROWS_LOG2 = 22
UNKNOWN = "und"
GRAMS = "__grams"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[65:91] = _PLAIN[97:123] = np.arange(97, 123)


@dataclass(frozen=True)
class LanguageFilter:
    """languages: by training size; rows: (words, positions) language bits; false_positive: per language.

    thin: languages of which grams seen often enough make up less than half of the training text.
    """

    languages: list[str]
    rows: np.ndarray
    false_positive: np.ndarray
    thin: tuple[str, ...] = ()


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of consecutive texts as 32-bit numbers, and each gram's text.

    Every text is framed by spaces; ASCII characters other than letters are spaces; grams with two
    neighbouring spaces are left out.
    """
    n = len(offsets) - 1
    wide = np.full(len(data) + n + 1, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    wide[at] = _PLAIN[data]
    if len(wide) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = wide.astype(np.uint32)
    code = (code[:-3] << np.uint32(24)) | (code[1:-2] << np.uint32(16)) | (code[2:-1] << np.uint32(8)) | code[3:]
    space = wide == 32
    pair = space[:-1] & space[1:]
    good = ~(pair[:-2] | pair[1:-1] | pair[2:])
    # one space lies between texts: a gram with it inside spans two of them
    limits = offsets[1:-1] + np.arange(1, n)
    for back in (1, 2):
        bad = limits - back
        good[bad[(bad >= 0) & (bad < len(good))]] = False
    begins = np.flatnonzero(good)
    return code[begins], np.searchsorted(offsets[1:] + np.arange(1, n + 1), begins, side="right").clip(0, n - 1)


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, count) over all rows of (lang, text)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            names, label = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            data, offsets = bytewords.text_buffers(batch.column(1))
            found: list[list[tuple]] = [[] for _ in names]
            for a, b in bytewords.chunks(offsets):
                code, text = grams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                own = label[a:b][text] if len(code) else np.zeros(0, int)
                for k in np.unique(own):
                    found[k].append(np.unique(code[own == k], return_counts=True))
            for k, parts in enumerate(found):
                if not parts:
                    continue
                codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes), names[k]), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)],
                    ["lang", "gram", "count"])

    picked = labelled.where("lang is not null and text is not null").select("lang", F.lower("text").alias("text"))
    counted = arrow_map(picked, run, "lang string, gram bigint, count bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def positions(code: np.ndarray, log2: int) -> list[np.ndarray]:
    mixed = bytewords.mix(code.astype(np.uint64) + np.uint64(1))
    mask = np.uint64((1 << log2) - 1)
    return [((mixed >> np.uint64(s)) & mask).astype(np.intp) for s in (0, 21, 42)]


def learn(labelled: DataFrame, share: float = SHARE, min_count: int = MIN_COUNT) -> LanguageFilter:
    """The filter learned from all rows of (lang, text)."""
    import pyarrow as pa

    counts = stored(count_grams(labelled), "grams")
    sums = counts.groupBy("lang").agg(F.sum("count").alias("total"), F.sum(F.when(F.col("count") >= min_count, F.col("count")).otherwise(0)).alias("often"))
    held = sums.collect()
    totals = sorted(((r["total"], r["lang"]) for r in held), key=lambda r: (-r[0], r[1]))
    thin = tuple(sorted(r["lang"] for r in held if 2 * r["often"] < r["total"]))
    languages = [lang for _, lang in totals]
    if not languages:
        return LanguageFilter([], np.zeros((1, 1), np.uint64), np.zeros(0))
    spark = labelled.sparkSession
    ranks = spark.createDataFrame([(lang, i, float(total)) for i, (total, lang) in enumerate(totals)], "lang string, rank int, total double")
    rated = counts.join(F.broadcast(ranks), "lang").withColumn("rate", F.col("count") / F.col("total"))
    # a language a row would be a list as long as the languages; two aggregations keep it flat
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    own = rated.join(top, "gram").where((F.col("count") >= min_count) & (F.col("rate") >= F.col("top") * share))
    own = own.join(F.broadcast(_least_counts(own, (1 << MAX_ROWS_LOG2) // 8 // len(languages))), "lang").where("count >= least")
    masks = stored(own.groupBy("gram", F.expr("cast(rank div 64 as int)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, rank % 64)")).alias("mask")), "masks")
    log2 = int(min(MAX_ROWS_LOG2, max(12, np.ceil(np.log2(max(1, masks.count()) * 8)))))

    def place(batches):
        for batch in batches:
            at = np.concatenate(positions(batch.column(0).to_numpy(), log2)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(batch.column(1).to_numpy(), HASHES)),
                                              pa.array(np.tile(batch.column(2).to_numpy(), HASHES))], ["at", "word", "mask"])

    placed = arrow_map(masks.select("gram", "word", "mask"), place, "at int, word int, mask bigint")
    held = placed.groupBy("at", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    rows = np.zeros((-(-len(languages) // 64), 1 << log2), np.uint64)
    rows[held["word"].to_numpy(), held["at"].to_numpy()] = held["mask"].to_numpy().astype(np.int64).view(np.uint64)
    fill = np.array([((rows[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return LanguageFilter(languages, rows, fill ** HASHES, thin)


def _least_counts(own: DataFrame, budget: int) -> DataFrame:
    """(lang, least): the count from which a language's grams, whole levels at a time, fit its part of the filter.

    A row a language, as many as the filter has bits. Each language keeps its most frequent grams, so a filter of
    bounded size holds the same share of positions a gram at every size of the corpus.
    """
    levels = own.groupBy("lang", "count").agg(F.count(F.lit(1)).alias("held"))
    above = F.sum("held").over(Window.partitionBy("lang").orderBy(F.desc("count")))
    fits = levels.withColumn("above", above).groupBy("lang").agg(
        F.min(F.when(F.col("above") <= budget, F.col("count"))).alias("least"), F.max("count").alias("top"))
    return fits.select("lang", F.coalesce("least", F.col("top") + 1).alias("least"))


def judge(code: np.ndarray, text: np.ndarray, n: int, model: LanguageFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of the language, its corrected share of the text's grams, and their number."""
    log2 = int(model.rows.shape[1]).bit_length() - 1
    total = np.bincount(text, minlength=n)
    best, choice = np.zeros(n), np.zeros(n, np.int64)
    where = positions(code, log2)
    for word, slices in enumerate(model.rows):
        masks = slices[where[0]] & slices[where[1]] & slices[where[2]]
        for bit in range(min(64, len(model.languages) - 64 * word)):
            lang = 64 * word + bit
            hits = np.bincount(text, weights=((masks >> np.uint64(bit)) & np.uint64(1)).astype(np.float64), minlength=n)
            fp = model.false_positive[lang]
            kept = np.clip((hits - total * fp) / (1.0 - fp) if fp < 1.0 else hits * 0.0, 0.0, None)
            better = kept > best
            best[better], choice[better] = kept[better], lang
    return choice, np.clip(best / np.maximum(total, 1), 0.0, 1.0), total


def predict(docs: DataFrame, model: LanguageFilter, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and the number of grams they rest on; no other column is read than the text.

    Columns of these names, in any case, are replaced.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", GRAMS)]
    width = len(own)

    def run(batches):
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], dtype=object)
        for batch in batches:
            data, offsets = bytewords.text_buffers(batch.column(width))
            choice, score, held = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for a, b in bytewords.chunks(offsets) if known.languages else ():
                code, text = grams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                choice[a:b], score[a:b], held[a:b] = judge(code, text, b - a, known)
            letters = batch.column(width + 1).to_numpy(zero_copy_only=False)
            choice[~letters], score[~letters] = len(known.languages), 0.0
            if not known.languages:
                choice[:] = 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(width)] + [pa.array(names[choice], pa.string()), pa.array(score), pa.array(held)],
                [*own, "lang_pred", "score", GRAMS])

    text = text_of(text_column)
    given = docs.select(*[F.col(f"`{c}`") for c in own], F.lower(text).alias("__lowered"), text.rlike(r"\p{L}").alias("__letters"))
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).schema.add("lang_pred", "string").add("score", "double").add(GRAMS, "long")
    return arrow_map(given, run, schema)


def teaching_rows(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Text and language of the rows outside the held-out quarter of the ids."""
    return docs.where(fold_of(id_column, 4) != 2).select("lang", "text")
